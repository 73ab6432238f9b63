"""WARC archives, written and read by one Python data source.

Writing: every record is a gzip member of its own, whose header says how long the member is (the "sl"
extra field of the format's recommendation for skip lengths). A task writes files of bounded size into
a staging folder under names of its own; the driver moves those of the attempts that count, so a lost
executor or a second attempt leaves nothing behind.

Reading: `WarcDataSource` plans a partition for each file, decompresses and parses a record's headers
first, tests on them what was pushed down (record type, record id, target, digest, length), and seeks
past the rest of the member, which is neither read nor decompressed; a payload is decoded only where
it is wanted or to be verified. Plain files and gzip files of other writers are read as well.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual, WriterCommitMessage

from civicledger.llm.common import materialise, release_memo

MIN_REVISIT_BYTES = 100
#: A file is closed once it holds so many bytes.
FILE_BYTES = 1 << 30
#: zlib's level: the fastest.
LEVEL = 1
#: Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SKIP_FIELD = b"sl"

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A record of SCHEMA per row of pages. Of equal payloads of at least min_bytes the smallest id's is a response, the others revisit it.

    Several rows of the smallest id are all responses. Rows with a null id revisit the smallest id if
    there is one. Null urls stay null, null html is an empty payload; other columns are ignored.

    What repeats is found on digests and ids alone. It is a written table, so Spark knows its size: it
    broadcasts a small one, and payloads stay where they are; beyond Spark's limit it joins by shuffling.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    out = out.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    again = out.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    again = materialise(again.filter("n > 1 AND first IS NOT NULL").select(F.unhex("payload_digest").alias("d"), "first"), "warc-repeats")
    out = out.join(again, F.unhex("payload_digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), "target_uri",
        F.when(revisit, name("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "gzip") -> None:
    """A record per row of pages under path, behind a warcinfo record in every file; see `plan_records`.

    compression: gzip, or none for plain files. White space and control characters in a url are written as %20.
    """
    records = plan_records(pages, id_col, url_col, html_col)
    pages.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = False, verify: bool = False) -> DataFrame:
    """The records under path. payload: whether payloads are wanted; else the column is null. verify: whether responses are held against their digests.

    Filters on the header columns reach the reader if the session's spark.sql.python.filterPushdown.enabled is true; else Spark applies them.
    """
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).option("pushdown", push).load(path)


def file_system(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path) with options payload, verify and pushdown; df.write.format("warc").save(path) with option compression."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        kind = PushingWarcReader if self.options.get("pushdown") == "true" else WarcReader
        return kind(self.options["path"], self.options.get("payload") == "true", self.options.get("verify") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") != "none")


@dataclass
class Written(WriterCommitMessage):
    """What an attempt has written: names in the staging folder."""

    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of SCHEMA."""

    def __init__(self, path: str, compressed: bool):
        self.path, self.compressed, self.staging = path.rstrip("/"), compressed, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        release_memo()
        fs, root = file_system(self.path)
        folder, names, out, size = f"{root}/{self.staging}", [], None, 0
        pack = member if self.compressed else lambda record: record
        fs.create_dir(folder, recursive=True)
        try:
            for b in iterator:
                for row in zip(*(b.column(name).to_pylist() for name in [*WarcReader.FIELDS, "payload"])):
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compressed else ''}")
                        out = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                        size = out.write(pack(info_record(names[-1])))
                    size += out.write(pack(record_of(*row)))
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.staging}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


def record_of(kind: str, ident: str, target: str | None, refers_to: str | None, digest: str, size: int, payload: bytes | None) -> bytes:
    """A record of an HTTP response, or of a revisit, which has the response's HTTP headers alone."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode()
    body = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}", *([] if target is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20]", "%20", target)]),
        f"WARC-Payload-Digest: sha256:{digest}", *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    return (CRLF.join(head) + CRLF + CRLF).encode() + body + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The record that opens a file."""
    body = f"format: WARC File Format 1.1{CRLF}".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return (CRLF.join(head) + CRLF + CRLF).encode() + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member with its own length and the record's in the extra field; 0 for lengths that 32 bits don't hold."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = 12 + 4 + 8 + len(body) + 8
    fits = max(length, len(record)) < 1 << 32
    extra = SKIP_FIELD + struct.pack("<HII", 8, length * fits, len(record) * fits)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcReader(DataSourceReader):
    FIELDS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes")

    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify, self.tests = path, payload, verify, []

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        if info.type == FileType.NotFound:
            return []
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        hidden = lambda x: any(re.match(r"[._]", part) for part in x.path[len(root) :].split("/") if part)
        return [InputPartition(x.path) for x in sorted(found, key=lambda x: -x.size) if x.type == FileType.File and x.size and not hidden(x)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no files
            return
        release_memo()
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.value) as raw:
            rows: list[tuple] = []
            held = 0
            for row in records(io.BufferedReader(raw, 1 << 20), self.wanted, self.payload, self.verify):
                rows.append(row)
                held += len(row[6] or b"")
                if len(rows) == 4096 or held > 1 << 23:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def wanted(self, row: tuple) -> bool:
        for kind, name, value in self.tests:
            x = row[self.FIELDS.index(name)]
            if x is None or not {"EqualTo": lambda: x == value, "In": lambda: x in value, "GreaterThanOrEqual": lambda: x >= value, "LessThanOrEqual": lambda: x <= value, "IsNotNull": lambda: True}[kind]():
                return False
        return True


class PushingWarcReader(WarcReader):
    """The reader of sessions that let filters be pushed down; Spark refuses a reader with this method in others."""

    def pushFilters(self, filters) -> Iterator:
        """Takes equality, membership, bounds and not-null on header fields; gives the others back."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThanOrEqual, LessThanOrEqual, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in self.FIELDS:
                self.tests.append((type(f).__name__, f.attribute[0], getattr(f, "value", None)))
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*WarcReader.FIELDS, "payload"])


class Member(io.RawIOBase):
    """What a gzip member holds, decompressed as far as it is read."""

    def __init__(self, raw, left: int):
        self.raw, self.left, self.inflate = raw, left, zlib.decompressobj(-15)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.raw.read(min(4096, self.left))
                self.left -= len(data)
                if not data:
                    raise ValueError("a member ends too early")
            out = self.inflate.decompress(data, len(into))
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def _ahead(stream, n: int) -> bytes:
    """The next n bytes, fewer only at the end; the stream stays where it is. Its own peek gives what its buffer still holds, which may be a byte."""
    found = stream.read(n)
    stream.seek(-len(found), io.SEEK_CUR)
    return found


def records(stream, wanted, payload: bool, verify: bool) -> Iterator[tuple]:
    """(type, id, target, refers to, digest, payload bytes, payload or None) of the wanted records of a file, plain or compressed."""
    while (start := _ahead(stream, 24))[:2] == b"\x1f\x8b":
        length = int.from_bytes(start[16:20], "little") if start[3:4] == b"\x04" and start[10:16] == struct.pack("<H", 12) + SKIP_FIELD + struct.pack("<H", 8) else 0
        if not length:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
            break
        end = stream.tell() + length
        stream.seek(24, io.SEEK_CUR)
        inside = io.BufferedReader(Member(stream, length - 32), 8192)
        row = _record(inside, wanted, payload, verify)[0]
        if row:
            yield row
        stream.seek(end)
    while line := stream.peek(1):
        if line[:1] in b"\r\n":
            stream.readline()
            continue
        row, left = _record(stream, wanted, payload, verify)
        if row:
            yield row
        stream.seek(left, io.SEEK_CUR)


def _headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _record(stream, wanted, payload: bool, verify: bool) -> tuple[tuple | None, int]:
    """The record that begins here, if it is wanted, and how many bytes of its block are yet to be passed."""
    line = stream.readline()
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    head = _headers(stream)
    size = left = int(head["content-length"])
    if "application/http" in head.get("content-type", ""):
        fields, used = {}, len(stream.readline())
        while line := stream.readline():
            used += len(line)
            if line in (b"\r\n", b"\n"):
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        left -= used
        size = int(fields.get("content-length", left))
    bare = lambda x: x.strip("<>") if x is not None else None
    digest = head.get("warc-payload-digest")
    row = (head.get("warc-type"), bare(head.get("warc-record-id")), head.get("warc-target-uri"), bare(head.get("warc-refers-to")), digest and digest.partition(":")[2], size)
    if not wanted(row):
        return None, left
    check = verify and row[0] == "response" and (digest or "").startswith("sha256:")
    body = None
    if payload or check:
        body = stream.read(left)
        if len(body) < left:
            raise ValueError(f"{row[1]} ends too early")
        left = 0
        if check and hashlib.sha256(body).hexdigest() != row[4]:
            raise ValueError(f"{row[1]} isn't what its digest says")
    return (*row, body if payload else None), left


def page_ids(column: str, id_type: str):
    """The page id of a record-id column."""
    return F.expr(f"try_cast(substring(`{column}`, {len('urn:page:') + 1}) AS {id_type})")


#: The query of op9 in DuckDB.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select html, min(page_id) as first from p where n >= 100 group by html having count(*) > 1)
select page_id, n::bigint as payload_bytes, sha256(p.html) as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from p left join f on p.html = f.html and n >= 100
"""
