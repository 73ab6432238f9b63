"""The stored ledger: tables as Parquet folders under one path, and a log of commits that says which folders count.

A change writes new folders first and then one line set to the log, in one file: what it adds and what it
takes away, of all tables at once. Readers see what the log names and nothing else, so a change that dies
leaves files that nobody reads, and a DataFrame that was made before a later change keeps its rows as
long as the files stay. Transactions and source documents lie by council, and the log names their
councils' parts, so that one council's rows are taken away without touching a file.

A table is one scan over all its folders, however many changes there were. `compact` packs small parts
into bins and rewrites each bin in a change of its own. Any number of writers may add at once; changes that
take something away are one writer's, and the second of two that take the same part away is void.

Columns that a later version adds are null in older files.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of the tables. fy is a financial year's label; ids are hashes of natural keys, so loading twice gives the same.
SCHEMAS = {
    "councils": "id long, name string, slug string, region string, transparency_url string, data_gov_id string, scrape_profile string, status string, last_scraped_at string, file_pattern string",
    "financial_years": "id long, council_id long, label string, start_date string, end_date string",
    "suppliers": "id long, council_id long, name string, normalised_name string",
    "source_documents": "id long, fy string, filename string, url string, type string, downloaded_at string, column_mapping string, batch string, council_id long",
    "budgets": "council_id long, fy string, directorate string, service string, category string, net_budget double, gross_budget double",
    "outturns": "council_id long, fy string, directorate string, service string, net_outturn double, variance double",
    "transactions": "supplier_id long, service string, directorate string, category string, description string, amount decimal(18,2), date string, month string, source_document_id long, file_row long, batch string, council_id long, fy string",
    "quarantine": "council_id long, url string, filename string, n_rows long, error string, noted_at string, batch string",
    "signatures": "table_name string, file string, bits binary",
}
#: How tables lie in folders; the first is what the log names parts by.
PARTITIONED = {"transactions": ("council_id", "fy"), "source_documents": ("council_id",)}
LOG = "commit string, at long, note string, kind string, table_name string, folder string, part string, bytes long, files long, rows long"
#: Several parts of less than SMALL bytes a file are worth rewriting; a bin of them is rewritten together.
SMALL, BIN = 32 << 20, 16 << 30


@dataclass(frozen=True)
class Entry:
    """A part of a table that counts: a folder, or what one council has in it."""

    table: str
    folder: str
    part: str
    bytes: int = 0
    files: int = 0

    @property
    def key(self) -> tuple[str, str, str]:
        return self.table, self.folder, self.part


class Ledger:
    """Tables under path, as of a time (nanoseconds; None: now). Nothing is read before it is used, and tables that aren't there are empty."""

    def __init__(self, spark: SparkSession, path: str, as_of: int | None = None):
        self.spark, self.path, self.as_of = spark, path.rstrip("/"), as_of

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Ledger:
        """A ledger under path, which may be there already."""
        out = cls(spark, path)
        spark.createDataFrame([], LOG).coalesce(1).write.mode("ignore").json(f"{out.path}/log/c=start")
        return out

    def history(self) -> DataFrame:
        """The log's lines: columns of LOG. kind: add, remove, or wrote (rows of a folder, as counted while it was written)."""
        try:
            log = self.spark.read.schema(LOG).json(f"{self.path}/log").select(*StructType.fromDDL(LOG).fieldNames())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log = self.spark.createDataFrame([], LOG)
        return log if self.as_of is None else log.filter(F.col("at") <= self.as_of)

    def _replay(self) -> tuple[dict[tuple, Entry], int, set[str]]:
        """What counts, the time of the last commit, and the commits that are void. The lines are as many as parts were ever added, not as rows."""
        commits: dict[tuple[int, str], list] = {}
        for r in self.history().collect():
            commits.setdefault((r["at"], r["commit"]), []).append(r)
        live: dict[tuple, Entry] = {}
        void: set[str] = set()
        for key in sorted(commits):
            gone = [(r["table_name"], r["folder"], r["part"]) for r in commits[key] if r["kind"] == "remove"]
            if any(g not in live for g in gone):
                void.add(key[1])  # another change had taken it away before
                continue
            for g in gone:
                del live[g]
            for r in commits[key]:
                if r["kind"] == "add":
                    e = Entry(r["table_name"], r["folder"], r["part"], r["bytes"], r["files"])
                    live[e.key] = e
        return live, max((at for at, _ in commits), default=0), void

    def entries(self, name: str | None = None) -> list[Entry]:
        return [e for e in self._replay()[0].values() if name in (None, e.table)]

    def scan(self, name: str, entries: list[Entry]) -> DataFrame:
        """The rows of these entries with the columns of SCHEMAS: one scan."""
        schema = StructType.fromDDL(SCHEMAS[name])
        if not entries:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{name}"
        return self.scan_paths(name, sorted(f"{base}/commit={e.folder}" + (f"/{e.part}" if e.part else "") for e in entries))

    def scan_paths(self, name: str, paths: list[str], with_file: bool = False) -> DataFrame:
        """The rows of a table's folders or files; with_file: and where each lies, in __file."""
        schema = StructType.fromDDL(SCHEMAS[name])
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)
        return found.select(*schema.fieldNames(), *([F.col("_metadata.file_path").alias("__file")] if with_file else []))

    def table(self, name: str) -> DataFrame:
        return self.scan(name, self.entries(name))

    def tables(self) -> dict[str, DataFrame]:
        """All tables as of one moment; what `civicledger.plans` asks its questions of."""
        live = self.entries()
        return {name: self.scan(name, [e for e in live if e.table == name]) for name in SCHEMAS}

    def begin(self, note: str = "") -> Change:
        return Change(self, note)

    def write(self, name: str, rows: DataFrame, replace: bool = False) -> None:
        """Adds rows to a table, or puts them in the place of all it has, as a change of its own."""
        with self.begin() as change:
            (change.replace if replace else change.add)(name, rows)

    def committed(self, note: str) -> bool:
        """Whether a change of that note counts."""
        found = {r["commit"] for r in self.history().filter(F.col("note") == note).select("commit").distinct().collect()}
        return bool(found) and bool(found - self._replay()[2])

    def compact(self, name: str, small: int = SMALL, bin_bytes: int = BIN) -> int:
        """Rewrites parts whose files are small, bin by bin. Returns how many parts it took away. Rows, and what earlier readers see, stay as they are."""
        by_part: dict[str, list[Entry]] = {}
        for e in self.entries(name):
            if e.bytes < small * max(1, e.files):
                by_part.setdefault(e.part, []).append(e)
        packed: list[list[Entry]] = []
        room: list[int] = []
        # first fit, largest parts first; what belongs to one council stays together
        for g in sorted((g for g in by_part.values() if len(g) > 1), key=lambda g: -sum(e.bytes for e in g)):
            size = sum(e.bytes for e in g)
            k = next((k for k, free in enumerate(room) if size <= free), None)
            if k is None:
                packed.append([])
                room.append(bin_bytes)
                k = len(room) - 1
            packed[k] += g
            room[k] -= size
        for entries in packed:
            with self.begin("compact") as change:
                change.add(name, self.scan(name, entries), clustered=True)
                change.remove(entries)
        return sum(map(len, packed))

    def unreferenced(self) -> DataFrame:
        """(path, length) of files under the tables that no commit names: left by changes that died. Files that only older readers see aren't among them."""
        known = self.history().filter("kind = 'add'").select("table_name", "folder").distinct()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path).select("path", "length")
        part = lambda k: F.regexp_extract("path", r"/([a-z_]+)/commit=([^/]+)/", k)
        files = files.withColumn("__table", part(1)).withColumn("__folder", part(2))
        return files.join(known, (F.col("__table") == F.col("table_name")) & (F.col("__folder") == F.col("folder")), "left_anti").select("path", "length")


class Change:
    """What is to be added and taken away at once. As a context it commits when it ends without an error."""

    def __init__(self, ledger: Ledger, note: str = ""):
        if ledger.as_of is not None:
            raise ValueError("a ledger of an earlier time isn't changed")
        self.ledger, self.note = ledger, note
        self.live, self.last, _ = ledger._replay()
        self.id = uuid.uuid4().hex
        self.lines: list[tuple] = []
        #: Rows of each table as they were counted while being written.
        self.rows: dict[str, int] = {}

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def table(self, name: str) -> DataFrame:
        """A table as it was when the change began, without what the change has taken away."""
        return self.ledger.scan(name, [e for e in self.live.values() if e.table == name])

    def add(self, name: str, rows: DataFrame, clustered: bool = False) -> None:
        """Writes rows into a folder of this change; columns that rows lack are null. clustered: dealt by partition first, large ones split, so that files are few."""
        ledger, folder = self.ledger, f"{self.id}-{len(self.lines)}"
        fields = StructType.fromDDL(SCHEMAS[name]).fields
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        lie = PARTITIONED.get(name, ())
        if clustered:
            rows = rows.hint("rebalance", *lie) if lie else rows.hint("rebalance")
        seen = Observation()
        path = f"{ledger.path}/{name}/commit={folder}"
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write
        (writer.partitionBy(*lie) if lie else writer).parquet(path)
        n = seen.get.get("rows", 0)
        self.rows[name] = self.rows.get(name, 0) + n
        files = ledger.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
        part = F.regexp_extract("path", rf"/commit={folder}/({lie[0]}=[^/]+)/", 1) if lie else F.lit("")
        for r in files.groupBy(part.alias("part")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).collect():
            self.lines.append(("add", name, folder, r["part"], r["bytes"], r["files"], None))
        self.lines.append(("wrote", name, folder, "", None, None, n))

    def remove(self, entries: list[Entry]) -> None:
        for e in entries:
            if e.key in self.live:
                del self.live[e.key]
                self.lines.append(("remove", *e.key, None, None, None))

    def drop(self, name: str, council_id: int | None = None) -> None:
        """Takes away a table's rows, or a council's of a table that lies by council."""
        if council_id is not None and PARTITIONED.get(name, ("",))[0] != "council_id":
            raise ValueError(f"{name} doesn't lie by council")
        self.remove([e for e in self.live.values() if e.table == name and (council_id is None or e.part == f"council_id={council_id}")])

    def replace(self, name: str, rows: DataFrame) -> None:
        self.add(name, rows)
        self.drop(name)

    def commit(self) -> None:
        """Makes the change count: one file in a folder of its own, which appears whole or not at all, whoever else commits at the time.

        Raises an error if another change had taken away before what this one takes away.
        """
        if not self.lines:
            return
        at = max(time.time_ns(), self.last + 1)
        rows = [(self.id, at, self.note, *line) for line in self.lines]
        self.ledger.spark.createDataFrame(rows, LOG).coalesce(1).write.json(f"{self.ledger.path}/log/c={self.id}")
        if any(line[0] == "remove" for line in self.lines) and self.id in self.ledger._replay()[2]:
            raise RuntimeError("another change has taken the same away; this one doesn't count")
