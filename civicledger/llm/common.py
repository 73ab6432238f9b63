"""What several operators share: scratch tables, word splitting, connected components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicledger.sources.scratch import scratch_dir

#: ASCII white space that separates words in all operators, as a Java/RE2 class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Spark's setting by which an execution's shuffle files go with its end instead of with the driver's garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A longer text is counted by parts of this many bytes.
PART = 1 << 20
#: Settings that are held for a while: (how many hold it, what it was).
_settings: dict[tuple[int, str], list] = {}
_settings_lock = threading.Lock()
#: What an operator keeps in this worker process between tasks: (its name, the object).
_memo: list = ["", None]


def worker_memo(owner: str, make: Callable[[], object]):
    """An operator's memo in this worker. A worker holds one memo at most: another owner's takes its place."""
    if _memo[0] != owner:
        _memo[:] = ["", None]
        _memo[:] = [owner, make()]
    return _memo[1]


def release_memo() -> None:
    """Called in the tasks of operators that keep nothing, so that none pays for what an earlier one has kept."""
    _memo[:] = ["", None]


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session while any thread is in here; the last one out puts back what was there."""
    with _settings_lock:
        held = _settings.setdefault((id(spark), key), [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _settings_lock:
            held[0] -= 1
            if not held[0]:
                del _settings[id(spark), key]
                spark.conf.unset(key) if held[1] is None else spark.conf.set(key, held[1])


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and any executor can be lost.

    Shuffle files of the write go when it ends, since nothing reads them again. The setting for that is put back afterwards.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def folding(digits: bool) -> bytes:
    """A table for bytes.translate: A-Z to a-z, other letters, all beyond ASCII and maybe digits as they are, the rest to spaces."""
    keep = lambda b: 97 <= b <= 122 or b >= 128 or (digits and 48 <= b <= 57)
    return bytes(b + 32 if 65 <= b <= 90 else b if keep(b) else 32 for b in range(256))


def terms_of(text: bytes, fold: bytes, part: int = PART) -> Iterator[list[bytes]]:
    """The terms of a text in order, by lists that are bounded in a text of any length but for a single term's own."""
    rest = b""
    for at in range(0, len(text), part):
        words = (rest + text[at : at + part].translate(fold)).split(b" ")
        rest = words.pop()
        yield list(filter(None, words))
    yield [rest] if rest else []


def drop_columns_like(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that clash, case-insensitively, with those an operator is about to add."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id_col is among ids; rows with a null id stay. All columns of docs stay, whatever their names."""
    gone, taken = "__gone", {c.lower() for c in docs.columns}
    while gone in taken:
        gone += "_"
    return docs.join(ids.select(F.col(id_col).alias(gone)).distinct(), F.col(id_col) == F.col(gone), "left_anti")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges, component being the smallest node reachable.

    Alternating large-star and small-star (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): each round is two aggregations; labels are never gathered on the driver. Rounds
    end when the sum and count of the edges no longer change; the number of rounds grows with the
    logarithm of the longest path. Each round's edges are written, so that the plan stays short.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        # written first: a join of two plain shuffles is one whose skewed keys Spark can split
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u").alias("k"), F.least("u", "m0").alias("m")), "cc-low")
        joined = both.join(low, both.u == low.k)
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    now = materialise(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct(), "cc"
    )
    state = None
    for _ in range(max_rounds):
        now = materialise(star(star(now, True), False), "cc")
        s = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (s[0], s[1]) == state:
            break
        state = (s[0], s[1])
    else:
        raise RuntimeError("connected components did not settle")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
