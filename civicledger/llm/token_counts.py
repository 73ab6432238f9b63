"""Token counts of whole texts by overlap resynchronisation.

A document of at most `chunk` characters is encoded in the task that reads it. A longer one is cut
into chunks that overlap; each chunk is encoded with offsets wherever Spark puts it, so one huge text
keeps no single task busy. Two neighbours are spliced at a proven stable boundary: an ASCII
white-space character (see `tokens`: no token of this tokenizer covers or looks across one) inside
the overlap, after which both encodings have the same ids at the same offsets up to the next white
space. Where an overlap holds no such boundary, the texts concerned are cut again with overlaps eight
times wider, at last whole.

Only counts leave a chunk: with F(b) the tokens of a chunk that begin before b, a text has
F_0(b_0) + sum of (F_k(b_k) - F_k(b_(k-1))) tokens.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.llm.common import materialise
from civicledger.llm.tokens import ids_of, load, portions

CHUNK = 32_768
OVERLAP = 512
WIDEN = 8
#: Texts whose overlaps would have to be wider than this are encoded whole.
WIDEST = 1 << 21


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit), resynced (was cut).

    Null and empty texts have 0 bytes and 0 tokens. Null ids, repeated ids and repeated rows keep
    their rows. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    size = F.char_length("__text")
    short = rows.filter(size <= chunk).select(id_col, F.col("__text").cast("binary").alias("__text"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def count_short(batches):
        for b in batches:
            texts, counts = b.column(1), []
            for i, n in portions(texts):
                counts += [len(x) // 4 for x in ids_of(texts.slice(i, n), tokenizer)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    counted = short.mapInArrow(count_short, f"`{id_col}` {id_type}, n_bytes long, n_tokens long").withColumn("resynced", F.lit(False))
    huge = rows.filter(size > chunk)
    totals = _huge_counts(huge.select(F.md5("__text").alias("fp"), "__text"), tokenizer, chunk, overlap)
    spliced = huge.select(id_col, F.octet_length("__text").cast("long").alias("n_bytes"), F.md5("__text").alias("fp")).join(totals, "fp").select(id_col, "n_bytes", "n_tokens", F.lit(True).alias("resynced"))
    return counted.unionByName(spliced).select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "resynced")


def _huge_counts(texts: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """(fp, n_tokens) of each distinct huge text."""
    done: DataFrame | None = None
    todo = texts
    while True:
        whole = overlap > WIDEST
        pieces = materialise(_encode(todo, tokenizer, chunk, overlap, whole), "token-seams")
        sums, failed = _splice(pieces)
        done = sums if done is None else done.unionByName(sums)
        if whole or failed.isEmpty():
            return done.groupBy("fp").agg(F.first("n_tokens").alias("n_tokens"))
        todo = texts.join(failed, "fp", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 2 * overlap)


def _encode(texts: DataFrame, tokenizer: str, chunk: int, overlap: int, whole: bool) -> DataFrame:
    """A row per chunk: fp, k, n_chunks, total, and the boundaries (p, sig, f) of the overlaps before and after it."""

    def cut(batches):
        for b in batches:
            for fp, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = 1 if whole else max(1, -(-(len(text) - overlap) // chunk))
                for k in range(n):
                    piece = text if n == 1 else text[k * chunk : min(len(text), (k + 1) * chunk + overlap)]
                    yield pa.RecordBatch.from_pydict({"fp": [fp], "k": [k], "n_chunks": [n], "piece": [piece]}, schema=pa.schema([("fp", pa.string()), ("k", pa.int64()), ("n_chunks", pa.int64()), ("piece", pa.string())]))

    seam = pa.list_(pa.struct([("p", pa.int64()), ("sig", pa.int64()), ("f", pa.int64())]))
    out = pa.schema([("fp", pa.string()), ("k", pa.int64()), ("n_chunks", pa.int64()), ("total", pa.int64()), ("head", seam), ("tail", seam)])

    def encode(batches):
        tok = load(tokenizer)[0]
        for b in batches:
            for r in b.to_pylist():
                e = tok.encode(r["piece"], add_special_tokens=False)
                starts, ids, at = [o[0] for o in e.offsets], e.ids, r["k"] * chunk
                head = boundaries(r["piece"], 0, overlap, at, starts, ids) if r["k"] else []
                tail = boundaries(r["piece"], chunk, chunk + overlap, at, starts, ids) if r["k"] + 1 < r["n_chunks"] else []
                yield pa.RecordBatch.from_pylist([{"fp": r["fp"], "k": r["k"], "n_chunks": r["n_chunks"], "total": len(ids), "head": head, "tail": tail}], schema=out)

    # copies of a huge text are cut once: rows of one fp are alike
    once = texts.dropDuplicates(["fp"])
    chunks = once.mapInArrow(cut, "fp string, k long, n_chunks long, piece string")
    return chunks.repartition("fp", "k").mapInArrow(encode, "fp string, k long, n_chunks long, total long, head array<struct<p:long,sig:long,f:long>>, tail array<struct<p:long,sig:long,f:long>>")


def boundaries(piece: str, lo: int, hi: int, at: int, starts: list[int], ids: list[int]) -> list[dict]:
    """White-space positions of piece[lo:hi] (counted from the text's start) with the ids up to the next one there and the tokens that begin before."""
    from bisect import bisect_left
    from zlib import crc32

    spaces = [i for i in range(lo, min(hi, len(piece))) if piece[i] in " \t\n\r\v\f"]
    out = []
    for p, q in zip(spaces, spaces[1:]):
        i, j = bisect_left(starts, p), bisect_left(starts, q)
        if j > i:
            out.append({"p": at + p, "sig": crc32(str([(s - p, t) for s, t in zip(starts[i:j], ids[i:j])]).encode()), "f": i})
    return out


def _splice(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the texts whose overlaps all hold a boundary that both sides prove; the other texts."""
    left = pieces.filter("k + 1 < n_chunks").select("fp", "k", "tail")
    right = pieces.filter("k > 0").select("fp", (F.col("k") - 1).alias("k"), "head")
    same = F.filter("tail", lambda x: F.exists("head", lambda y: (y.p == x.p) & (y.sig == x.sig)))
    seams = left.join(right, ["fp", "k"]).select("fp", "head", F.get(same, F.lit(0)).alias("cut"))
    seams = seams.select("fp", (F.col("cut.f") - F.get(F.filter("head", lambda y: (y.p == F.col("cut.p")) & (y.sig == F.col("cut.sig"))), F.lit(0)).f).alias("add"))
    last = pieces.filter("k + 1 = n_chunks").select("fp", F.col("total").alias("add"))
    sums = seams.union(last).groupBy("fp").agg(F.sum("add").alias("n_tokens"), F.max(F.col("add").isNull()).alias("open"))
    return sums.filter("NOT open").select("fp", "n_tokens"), sums.filter("open").select("fp")
