"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A `LineStore` holds which document holds which line key (`holders`), how many documents hold each
key, the smallest of them and the filter that has the key's entry (`refs`), and for each shard of the
key space cuckoo filters with one entry per key (`filters`). An inserted batch probes the filters
first: keys that they don't know are new for certain and are appended; only the others are joined with
the exact table, which also shows false alarms, that then get an entry too. A deletion takes the
documents' holder rows away, counts the keys concerned again and removes those without holders from
the very filter that has their entry, so that insert followed by delete leaves what was there before.

Lines are reduced to (16-byte key, document) before anything moves, and keys are aggregated before
they meet a shard, so a line that a third of all documents hold is one row there. When the keys have
outgrown the shards, these are dealt anew, twice as many as needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicledger.llm.common import drop_columns_like, materialise, release_memo

MIN_CHARS = 10
SLOTS = 4
#: Share of a filter's slots that may be taken before the next filter of its shard is begun.
FULL = 0.9
KICKS = 500
#: Keys of a shard, about, when shards are dealt; at twice as many they are dealt anew.
KEYS_PER_SHARD = 100_000
#: Batches in which a whole table goes into a new store.
BATCHES = 2


class CuckooFilter:
    """16-bit fingerprints in buckets of four; two buckets for each key, one from the other by the fingerprint alone."""

    def __init__(self, buckets: int = 1024, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(8, int(np.ceil(np.log2(max(1, keys) / (FULL * SLOTS))))))

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def free(self) -> int:
        return max(0, int(FULL * self.table.size) - int(np.count_nonzero(self.table)))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 2) unsigned 64-bit. Fingerprint and first bucket come from different halves of the key."""
        fp = (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (keys[:, 0] >> np.uint64(16)) & np.uint64(len(self.table) - 1)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        step = (fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (bucket ^ step) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)

    def _settle(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Puts what finds a free slot of its bucket there; says which did."""
        order = np.argsort(bucket, kind="stable")
        sorted_buckets = bucket[order]
        first = np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rank = np.arange(len(order)) - start
        empty = self.table[sorted_buckets] == 0
        nth = np.cumsum(empty, axis=1) == (rank + 1)[:, None]
        slot = (nth & empty).argmax(axis=1)
        fits = (nth & empty).any(axis=1)
        self.table[sorted_buckets[fits], slot[fits]] = fp[order[fits]]
        done = np.zeros(len(order), bool)
        done[order[fits]] = True
        return done

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds each key once; True where it was added. The caller begins another filter for the rest.

        A key that isn't added leaves the filter without a trace: its chain of kicks is undone.
        """
        if not len(keys):
            return np.zeros(0, bool)
        fp, a, b = self._places(keys)
        done = self._settle(a, fp)
        rest = np.flatnonzero(~done)
        if len(rest):
            done[rest] = self._settle(b[rest], fp[rest])
        for k in np.flatnonzero(~done):
            done[k] = self._kick(int(b[k]), int(fp[k]))
        return done

    def _kick(self, bucket: int, fp: int) -> bool:
        undo = []
        for step in range(KICKS):
            row = self.table[bucket]
            empty = np.flatnonzero(row == 0)
            slot = int(empty[0]) if len(empty) else step % SLOTS
            undo.append((bucket, slot, int(row[slot])))
            row[slot], fp = fp, int(row[slot])
            if not fp:
                return True
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([fp], np.uint16))[0])
        for bucket, slot, old in reversed(undo):
            self.table[bucket, slot] = old
        return False

    def remove(self, keys: np.ndarray) -> np.ndarray:
        """Takes one entry of each key out; True where there was one."""
        out = np.zeros(len(keys), bool)
        for k, (fp, a, b) in enumerate(zip(*self._places(keys))):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == fp)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    out[k] = True
                    break
        return out


def key_array(column: pa.ChunkedArray) -> np.ndarray:
    """16-byte keys as (n, 2) unsigned 64-bit."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def maybe_known(filters: list[CuckooFilter], keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the shard; False is certain."""
    known = np.zeros(len(keys), bool)
    for f in filters:
        known |= f.contains(keys)
    return known


def add_keys(filters: list[CuckooFilter], keys: np.ndarray) -> np.ndarray:
    """The number of the filter that took each key; further filters are begun as they fill."""
    gen = np.full(len(keys), -1, np.int32)
    todo = np.arange(len(keys))
    while len(todo):
        room = filters[-1].free() if filters else 0
        if not room:
            filters.append(CuckooFilter.sized(len(todo)))
            continue
        added = filters[-1].insert(keys[todo[:room]])
        gen[todo[:room][added]] = len(filters) - 1
        left = todo[:room][~added]
        todo = np.r_[left, todo[room:]]
        if len(left):  # too crowded for these
            filters.append(CuckooFilter.sized(2 * len(todo)))
    return gen


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a UTF-8 line: ASCII white space stripped, A-Z lower-cased; None for shorter ones."""
    import xxhash

    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class LineStore:
    """See the module's text. Every change writes new tables into the shared folder; the old ones stay readable.

    Rows with a null id hold no lines and lose none. Several rows of one id are one document: its
    lines count once for it and are never dropped on account of another row of it. Null texts are
    one empty line. Inserting a document again, or deleting one that isn't there, changes nothing.
    """

    def __init__(self, spark: SparkSession, id_type: str = "long", min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD):
        self.spark, self.id_type, self.min_chars, self.keys_per_shard, self.shards = spark, id_type, min_chars, keys_per_shard, 0
        self.holders: DataFrame | None = None
        self.refs: DataFrame | None = None
        self.filters: DataFrame | None = None

    def _occurrences(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        min_chars = self.min_chars

        def keys(batches):
            release_memo()
            for b in batches:
                rows, out = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    found = {line_key(x, min_chars) for x in text.split(b"\n")}
                    found.discard(None)
                    rows += [i] * len(found)
                    out += found
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(0).take(pa.array(rows, pa.int64()))], ["key", "id"])

        texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
        return texts.mapInArrow(keys, f"key binary, id {self.id_type}").distinct()

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def _through_filters(self, keys: DataFrame, filters: DataFrame | None, add_known: bool, name: str) -> tuple[DataFrame, DataFrame]:
        """(keys with known and gen, filters) after each shard's keys have met its filters.

        Keys that the filters don't know are added, with add_known the others too; gen is null for those that weren't.
        keys: key, refs, keeper; a row per key.
        """
        if filters is None:
            filters = self.spark.createDataFrame([], "shard int, gen int, bits binary")
        kind = f"shard int, key binary, refs long, keeper {self.id_type}, known boolean, gen int, bits binary"

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("gen")
            held = [CuckooFilter.from_bytes(x) for x in right.column("bits").to_pylist()]
            n = left.num_rows
            shard = (left if n else right).column("shard")[0].as_py()
            known, gen = np.zeros(n, bool), np.full(n, -1, np.int32)
            if n:
                keys = key_array(left.column("key"))
                known = maybe_known(held, keys)
                new = np.arange(n) if add_known else np.flatnonzero(~known)
                gen[new] = add_keys(held, keys[new])
            m = len(held)
            whole = lambda a, t: pa.concat_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a, pa.nulls(m, t)])
            cols = [
                pa.array([shard] * (n + m), pa.int32()), whole(left.column("key"), pa.binary()), whole(left.column("refs"), pa.int64()),
                whole(left.column("keeper"), left.schema.field("keeper").type), whole(pa.array(known), pa.bool_()),
                pa.concat_arrays([pa.array(gen, pa.int32(), mask=gen < 0), pa.array(range(m), pa.int32())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([f.to_bytes() for f in held], pa.binary())]),
            ]
            return pa.Table.from_arrays(cols, ["shard", "key", "refs", "keeper", "known", "gen", "bits"])

        sharded = keys.select(self._shard(), "key", "refs", "keeper").groupBy("shard")
        out = materialise(sharded.cogroup(filters.groupBy("shard")).applyInArrow(meet, kind), name)
        return out.filter("key IS NOT NULL").select("key", "refs", "keeper", "known", "gen"), out.filter("bits IS NOT NULL").select("shard", "gen", "bits")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Puts documents in."""
        occ = materialise(self._occurrences(docs, id_col, text_col), "line-occurrences")
        if self.holders is not None:
            occ = materialise(occ.join(self.holders, ["key", "id"], "left_anti"), "line-occurrences")
        if not self.shards:
            self.shards = max(16, -(-occ.count() // self.keys_per_shard))
        keys = occ.groupBy("key").agg(F.count("*").alias("refs"), F.min("id").alias("keeper"))
        batch, self.filters = self._through_filters(keys, self.filters, False, "line-probed")
        if self.refs is None:
            self.refs, self.holders = batch.drop("known"), occ
            return
        known = batch.filter("known").select("key", F.col("refs").alias("more"), F.col("keeper").alias("low"))
        merged = self.refs.join(known, "key", "left").select("key", (F.col("refs") + F.coalesce("more", F.lit(0))).alias("refs"), F.least("keeper", "low").alias("keeper"), "gen")
        # keys that a filter took for known, though they are new, get an entry of their own: each key has one
        alarms = materialise(known.join(self.refs, "key", "left_anti").select("key", F.col("more").alias("refs"), F.col("low").alias("keeper")), "line-alarms")
        added = merged.unionByName(batch.filter("NOT known").drop("known"))
        if not alarms.isEmpty():
            taken, self.filters = self._through_filters(alarms, self.filters, True, "line-added")
            added = added.unionByName(taken.drop("known"))
        self.refs = materialise(added, "line-refs")
        self.holders = materialise(self.holders.unionByName(occ), "line-holders")
        count = self.refs.count()
        if count > 2 * self.keys_per_shard * self.shards:
            self.shards = 2 * -(-count // self.keys_per_shard)
            dealt, self.filters = self._through_filters(self.refs, None, True, "line-dealt")
            self.refs = dealt.drop("known")

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes the documents of these ids out."""
        if self.holders is None:
            return
        ids = ids.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
        touched = materialise(self.holders.join(ids, "id", "left_semi").select("key").distinct().join(self.refs.select("key", "gen"), "key"), "line-touched")
        self.holders = materialise(self.holders.join(ids, "id", "left_anti"), "line-holders")
        again = self.holders.join(touched, "key").groupBy("key", "gen").agg(F.count("*").alias("refs"), F.min("id").alias("keeper"))
        again = materialise(again, "line-recounted")
        self.refs = materialise(self.refs.join(touched, "key", "left_anti").unionByName(again), "line-refs")
        gone = touched.join(again, "key", "left_anti").select(self._shard(), "gen", "key")

        def remove(left: pa.Table, right: pa.Table) -> pa.Table:
            """A filter, without what is gone from it."""
            f = CuckooFilter.from_bytes(right.column("bits")[0].as_py())
            if left.num_rows and not f.remove(key_array(left.column("key"))).all():
                raise ValueError("a filter lacks a key that was put into it")
            return pa.table({"shard": right.column("shard"), "gen": right.column("gen"), "bits": pa.array([f.to_bytes()], pa.binary())})

        self.filters = materialise(gone.groupBy("shard", "gen").cogroup(self.filters.groupBy("shard", "gen")).applyInArrow(remove, "shard int, gen int, bits binary"), "line-filters")

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs, which are in the store, with their texts rebuilt and with n_lines and n_dropped; other columns stay.

        Lines that another stored document of a smaller id holds go. An id that isn't in the store loses none.
        Columns called n_lines or n_dropped are replaced.
        """
        min_chars = self.min_chars
        docs = drop_columns_like(docs, ["n_lines", "n_dropped", "__drop", "__id"])
        shared = self.refs.filter("refs > 1").select("key", "keeper")
        drops = self.holders.join(shared, "key").filter("id <> keeper").groupBy(F.col("id").alias("__id")).agg(F.collect_list("key").alias("__drop"))
        joined = docs.join(drops, docs[id_col] == drops["__id"], "left").drop("__id")
        names = [c for c in joined.columns if c != "__drop"]
        at, kind = names.index(text_col), docs.schema[text_col].dataType.simpleString()
        joined = joined.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
        fields = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in joined.schema if f.name != "__drop")

        def rebuild(batches):
            release_memo()
            for b in batches:
                texts, counts, dropped = [], [], []
                for text, drop in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                    lines = text.split(b"\n")
                    if drop:
                        gone = set(drop)
                        kept = [x for x in lines if line_key(x, min_chars) not in gone]
                        text = b"\n".join(kept)
                    else:
                        kept = lines
                    texts.append(text)
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                cols = [pa.array(texts, pa.binary()) if i == at else b.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

        out = joined.mapInArrow(rebuild, fields + ", n_lines long, n_dropped long")
        return out.withColumn(text_col, F.col(text_col).cast(kind))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """One whole table through a new store, in batches of ids: each batch but the first is probed against the filters of those before it."""
    store = LineStore(docs.sparkSession, docs.schema[id_col].dataType.simpleString(), min_chars)
    for k in range(batches):
        store.insert(docs.filter(F.pmod(F.xxhash64(id_col), F.lit(batches)) == k), id_col, text_col)
    return store.clean(docs, id_col, text_col)


#: The query of op8 in DuckDB.
ORACLE = """
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (select rid, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
h as (select key, count(distinct doc_id) as n, min(doc_id) as keeper from k where length(key) >= 10 group by key),
m as (select rid, i, line, coalesce(h.n >= 2 and k.doc_id <> h.keeper, false) as gone from k left join h on h.key = k.key and length(k.key) >= 10)
select d.doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m join d using (rid) group by d.rid, d.doc_id
"""
