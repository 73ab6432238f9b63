"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, the document frequencies counted over
all documents. A randomised SVD, its products summed over Spark's partitions, gives every term a
latent vector. Each document's windows are folded in as sums of their terms' vectors and compared
with the passages by cosine; candidates are then verified on the words themselves: the longest common
subsequence must hold most of the passage, and its answer words must stand in the window.

A latent space serves a few hundred items, so that its rank keeps up with the benchmark. Retrieval by
cosine still loses windows in which a short passage is drowned, so compact copies (most of a passage's
words in order, within little more than its length) are also found by an exact way: a passage's rarest
words are indexed, so many of them that a copy can't lack all, and where enough of them stand together
the words decide. What the cosine adds are looser copies.

The benchmark is taken in blocks of bounded size, each of which is held against all documents in two
map-only passes, so only what a block needs is sent to the tasks and documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.llm.common import materialise, release_memo
from civicledger.llm.license_scans import words_of

#: Items whose index is held in memory at once; more are taken in further blocks.
BLOCK_ITEMS = 5_000
#: Items that share a latent space of RANK dimensions; a block has as many spaces as it takes.
LATENT_ITEMS = 500
#: Words of a passage at most, and of the two sizes of window; windows begin STRIDE words apart.
PASSAGE = 64
WINDOWS = (32, 64)
STRIDE = 16
#: Terms in more than this share of all documents say nothing about a passage, unless it has no others.
MAX_DF = 0.05
#: Documents that a term may stand in beyond that share, at any size of the table: few documents tell little about a share.
SPARE_DOCS = 20
MIN_TERMS = 3
#: Latent dimensions, those that the random projection adds, and power iterations.
RANK = 96
OVERSAMPLE = 16
POWER = 2
MIN_COSINE = 0.5
#: Share of a passage's words that must stand in the window in their order.
MIN_LCS = 0.8
#: Words that count as a passage's answer: the rarest among an item's last END_WORDS, as items end with it, and of a whole passage in its middle.
#: The fewer of them stand in the window, the larger a share of the passage must: SHARES by their number.
ANSWER_WORDS = 3
END_WORDS = 8
SHARES = (0.84, MIN_LCS)
#: Rare words of a passage that must stand together before its words are compared, beyond those that a copy may lack.
SUPPORT = 4
#: Words of a text whose postings are laid out at once.
SEGMENT = 16_384


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        match = row & where.get(w, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def passages_of(items: list[tuple], size: int = PASSAGE) -> list[tuple[int, list[bytes]]]:
    """(index of the item, words); a long item gives several, the last as long as the others."""
    out = []
    for i, (_, text) in enumerate(items):
        words = words_of((text or "").encode())
        starts = list(range(0, max(1, len(words) - size + 1), size)) if words else []
        if starts and starts[-1] + size < len(words):
            starts.append(len(words) - size)
        out += [(i, words[s : s + size]) for s in starts]
    return out


def answers_of(passages: list[tuple[int, list[bytes]]], df: dict[bytes, int]) -> list[frozenset[bytes]]:
    """The answer words of each passage."""
    ends = [p + 1 == len(passages) or passages[p + 1][0] != item for p, (item, _) in enumerate(passages)]
    return [frozenset(sorted(set(words[-END_WORDS:] if end else words), key=lambda w: (df.get(w, 0), w))[:ANSWER_WORDS]) for end, (_, words) in zip(ends, passages)]


def least_share(answers: frozenset[bytes], found: int) -> float:
    """The share of a passage that must stand where so many of its answer words do."""
    return MIN_LCS if found >= len(answers) else SHARES[min(found, len(SHARES) - 1)]


def _sum_blocks(rows: DataFrame, make, width: int, terms: int) -> np.ndarray:
    """The (terms, width) sum of make(row batch) over all partitions. Bounded by the block's terms and the rank."""
    def partial(batches):
        total = np.zeros((terms, width), np.float32)
        for b in batches:
            make(total, b)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["k", "m"])

    def add(batches):
        total = np.zeros(terms * width, np.float32)
        for b in batches:
            for m in b.column(0).to_pylist():
                total += np.frombuffer(m, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    # two levels of sums: a task adds up a few partitions' matrices, the driver the few that are left
    parts = rows.mapInArrow(partial, "k int, m binary").select("m")
    found = parts.repartition(4).mapInArrow(add, "m binary")
    return sum((np.frombuffer(r["m"], np.float32).reshape(terms, width).astype(float) for r in found.collect()), np.zeros((terms, width)))


def randomised_svd(rows: DataFrame, terms: int, rank: int = RANK, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms, rank) of the sparse matrix in rows (idx array<int>, val array<double>).

    Halko, Martinsson and Tropp's subspace iteration on the Gram matrix: each pass is a sum over partitions of a' (a V).
    """
    width = min(terms, rank + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(power + 1):
        shared = rows.sparkSession.sparkContext.broadcast(basis.astype(np.float32))  # a latent space's terms by its rank

        def gram(total: np.ndarray, b: pa.RecordBatch, shared=shared) -> None:
            basis = shared.value
            for idx, val in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                val = np.asarray(val, np.float32)
                total[idx] += np.outer(val, val @ basis[idx])

        image = _sum_blocks(rows, gram, width, terms)
        shared.destroy()
        last, basis = basis, np.linalg.qr(image)[0]
    small = last.T @ image  # V' A'A V
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return (last @ vectors[:, ::-1])[:, : min(rank, width)]


class LatentIndex:
    """A block's passages: term vectors, unit latent passages, and what verification needs."""

    def __init__(self, passages, vocab: dict[bytes, int], weights: np.ndarray, vectors: np.ndarray, df: dict[bytes, int]):
        self.passages, self.vocab = passages, vocab
        self.terms = (weights[:, None] * vectors).astype(np.float32)
        latent = np.zeros((len(passages), vectors.shape[1]), np.float32)
        for p, (_, words) in enumerate(passages):
            for w in words:
                if w in vocab:
                    latent[p] += self.terms[vocab[w]]
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        # what surrounds a window and holds fewer of a passage's telling words than this can't hold enough of the passage
        self.need = np.maximum(1, [sum(w in vocab for w in words) - len(words) + math.ceil(MIN_LCS * len(words) - 1e-9) for _, words in passages])
        self.half = np.array([len(words) // 2 for _, words in passages])
        self.reach = int(self.half.max())
        of_word: list[list[int]] = [[] for _ in vocab]
        for p, (_, words) in enumerate(passages):
            for w in set(words):
                if w in vocab:
                    of_word[vocab[w]].append(p)
        self.count = np.array([len(x) for x in of_word])
        self.first = np.cumsum(self.count) - self.count
        self.postings = np.array([p for x in of_word for p in x], np.int64)
        self.answers = answers_of(passages, df)

    def cosine(self, words: list[bytes], p: int) -> float:
        """Of a stretch of words and a passage."""
        at = [self.vocab[w] for w in words if w in self.vocab]
        vector = self.terms[at].sum(axis=0)
        return float(vector @ self.latent[p] / max(float(np.linalg.norm(vector)), 1e-9))

    def search(self, words: list[bytes]) -> dict[int, tuple[float, float, int, int]]:
        """{item: (cosine, LCS share, answer words, window's first word)} of what is verified in a text."""
        out: dict[int, tuple[float, float, int, int]] = {}
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(ids >= 0)
        for first in range(0, len(words), SEGMENT):
            lo, hi = np.searchsorted(places, [first - self.reach, first + SEGMENT + max(WINDOWS) + self.reach])
            if hi > lo:
                self._search(words, first, places[lo:hi], ids[places[lo:hi]], out)
        return out

    def _search(self, words: list[bytes], first: int, places: np.ndarray, ids: np.ndarray, out: dict) -> None:
        """The windows that begin in a segment; places and ids of the telling words that can stand in or around them."""
        count = self.count[ids]
        total = int(count.sum())
        p = self.postings[np.repeat(self.first[ids] - np.cumsum(count) + count, count) + np.arange(total)]
        order = np.argsort(p, kind="stable")
        p, at = p[order], np.repeat(places, count)[order]
        last = np.arange(total) + self.need[p] - 1
        able = np.flatnonzero(last < total)
        last = last[able]
        same = (p[last] == p[able]) & (at[last] - at[able] < max(WINDOWS) + 2 * self.half[p[able]])
        p, begin, end = p[able[same]], at[able[same]], at[last[same]]
        for size in WINDOWS if len(p) else ():
            # windows around which a passage's words stand so close
            low = np.maximum(-((size + self.half[p] - 1 - end) // STRIDE), first // STRIDE)
            high = np.minimum((begin + self.half[p]) // STRIDE, min(max(0, len(words) - size + STRIDE - 1), first + SEGMENT - 1) // STRIDE)
            n = np.maximum(0, high - low + 1)
            window = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pairs = np.unique(window * len(self.passages) + np.repeat(p, n))
            window, passage = pairs // len(self.passages) * STRIDE, pairs % len(self.passages)
            for k in range(0, len(pairs), 4096):
                starts, where = np.unique(window[k : k + 4096], return_inverse=True)
                cosine = np.einsum("ij,ij->i", self._vectors(starts, size, places, ids)[where], self.latent[passage[k : k + 4096]])
                there, of = set(), -1
                for i in np.flatnonzero(cosine >= MIN_COSINE).tolist():
                    start, own = int(window[k + i]), int(passage[k + i])
                    if start != of:
                        of, there = start, set(words[max(0, start - self.reach) : start + size + self.reach])
                    # no common subsequence is longer than the passage's words that stand there at all
                    pattern = self.passages[own][1]
                    if sum(map(there.__contains__, pattern)) >= MIN_LCS * len(pattern):
                        self._verify(words, start, size, own, float(cosine[i]), out)

    def _vectors(self, starts: np.ndarray, size: int, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Unit latent vectors of windows; zero for one without telling words."""
        lo, hi = np.searchsorted(places, starts), np.searchsorted(places, starts + size)
        out = np.zeros((len(starts), self.terms.shape[1]), np.float32)
        full = np.flatnonzero(hi > lo)
        if len(full):
            n = hi[full] - lo[full]
            found = self.terms[ids[np.repeat(lo[full] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]]
            out[full] = np.add.reduceat(found, np.cumsum(n) - n, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _verify(self, words, begin: int, size: int, p: int, cosine: float, out: dict) -> None:
        item, pattern = self.passages[p]
        best = out.get(item)
        if best and best[1] == 1.0:
            return
        around = words[max(0, begin - len(pattern) // 2) : begin + size + len(pattern) // 2]
        answers = len(self.answers[p].intersection(around))
        least = least_share(self.answers[p], answers)
        if least > MIN_LCS and sum(map(set(around).__contains__, pattern)) < least * len(pattern):
            return
        share = lcs_length(pattern, around) / len(pattern)
        if share >= least and (best is None or share > best[1]):
            out[item] = (cosine, share, answers, begin)


class CompactIndex:
    """A block's passages by their rarest words, for copies of MIN_LCS of a passage's words within 1 / MIN_LCS of its length. Exact.

    A copy lacks at most the share 1 - MIN_LCS of the passage's places, so of that many rarest places and a few more it holds the few.
    """

    def __init__(self, passages, df: dict[bytes, int]):
        self.passages = passages
        self.answers = answers_of(passages, df)
        self.need = [math.ceil(MIN_LCS * len(words) - 1e-9) for _, words in passages]
        self.span = np.array([math.ceil(len(words) / MIN_LCS - 1e-9) for _, words in passages])
        self.support = np.array([min(SUPPORT, need) for need in self.need])
        postings: dict[bytes, list[int]] = {}
        for p, (_, words) in enumerate(passages):
            rare = sorted(words, key=lambda w: (df.get(w, 0), w))[: len(words) - self.need[p] + int(self.support[p])]
            for w in set(rare):
                postings.setdefault(w, []).append(p)
        self.word = {w: i for i, w in enumerate(postings)}
        self.count = np.array([len(x) for x in postings.values()])
        self.first = np.cumsum(self.count) - self.count
        self.postings = np.array([p for x in postings.values() for p in x], np.int32)

    def search(self, words: list[bytes]):
        """(passage, from, to): stretches of a text in which a copy of the passage may lie; each copy lies in one of them."""
        ids = np.fromiter(map(self.word.get, words, repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(ids >= 0)
        if not len(places):
            return
        ids = ids[places]
        reach = int(self.span.max())
        for begin in range(0, len(words), SEGMENT):
            lo, hi = np.searchsorted(places, [begin, begin + SEGMENT + reach])
            count = self.count[ids[lo:hi]]
            total = int(count.sum())
            p = self.postings[np.repeat(self.first[ids[lo:hi]] - np.cumsum(count) + count, count) + np.arange(total)]
            order = np.argsort(p, kind="stable")
            p, at = p[order], np.repeat(places[lo:hi], count)[order]
            last = np.arange(total) + self.support[p] - 1
            able = np.flatnonzero(last < total)
            last = last[able]
            close = (p[last] == p[able]) & (at[last] - at[able] < self.span[p[able]])
            for x, first, end in zip(p[able[close]].tolist(), at[able[close]].tolist(), at[last[close]].tolist()):
                size = int(self.span[x])
                yield x, max(0, end - size + 1), first + size

    def verify(self, words: list[bytes], p: int, lo: int, hi: int, best: float) -> tuple[float, int, int] | None:
        """(LCS share, answer words, first word) of the best copy in a stretch, if it holds more than the share best."""
        pattern, need, size = self.passages[p][1], self.need[p], int(self.span[p])
        stretch = words[lo:hi]
        there = set(stretch)
        if sum(map(there.__contains__, pattern)) < need:
            return None
        n = lcs_length(pattern, stretch)
        if n < need or n / len(pattern) <= best:
            return None
        found, own = None, set(pattern)
        for begin in range(len(stretch)):
            if stretch[begin] not in own:
                continue
            around = stretch[begin : begin + size]
            answers = len(self.answers[p].intersection(around))
            share = lcs_length(pattern, around) / len(pattern)
            if share > best and share * len(pattern) > need - 0.5 and share >= least_share(self.answers[p], answers) - 1e-9:
                found, best = (share, answers, lo + begin), share
                if share == 1.0:
                    break
        return found


class BlockIndex:
    """A block's latent spaces and its exact index; passages are numbered through."""

    def __init__(self, latent: list[LatentIndex], compact: CompactIndex):
        self.latent, self.compact = latent, compact
        self.space = [(index, p) for index in latent for p in range(len(index.passages))]

    def search(self, words: list[bytes]) -> dict[int, tuple[float, float, int, int]]:
        """As LatentIndex.search: what is found by cosine, and all compact copies."""
        out: dict[int, tuple[float, float, int, int]] = {}
        for index in self.latent:
            out.update(index.search(words))
        for p, lo, hi in self.compact.search(words):
            item = self.compact.passages[p][0]
            best = out[item][1] if item in out else 0.0
            hit = self.compact.verify(words, p, lo, hi, best) if best < 1.0 else None
            if hit:
                index, own = self.space[p]
                share, answers, begin = hit
                out[item] = (index.cosine(words[begin : begin + int(self.compact.span[p])], own), share, answers, begin)
        return out


def _frequencies(texts: DataFrame, vocab: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents in all and those that hold each word of the vocabulary."""
    def count(batches):
        n, df = 0, Counter()
        for b in batches:
            n += b.num_rows
            for text in b.column(1).to_pylist():
                df.update(vocab.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *df], pa.binary()), pa.array([n, *df.values()], pa.int64())], ["word", "n"])

    rows = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in rows}
    return df.pop(b"", 0), df


def _latent_index(spark, passages, df: dict[bytes, int], n: int, rank: int) -> LatentIndex:
    everything = {w for _, ws in passages for w in ws}
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in everything}
    telling = {w for w in everything if df.get(w, 0) <= SPARE_DOCS + MAX_DF * n}
    for _, ws in passages:
        if len(telling.intersection(ws)) < MIN_TERMS:
            telling.update(sorted(set(ws), key=lambda w: (-idf[w], w))[:MIN_TERMS])
    vocab = {w: i for i, w in enumerate(sorted(telling))}
    weights = np.zeros(len(vocab))
    for w, i in vocab.items():
        weights[i] = idf[w]
    matrix = []
    for _, ws in passages:
        tf = Counter(vocab[w] for w in ws if w in vocab)
        val = np.array([c * weights[i] for i, c in tf.items()])
        matrix.append((list(tf), (val / max(1e-9, np.linalg.norm(val))).tolist()))
    rows = spark.createDataFrame(matrix, "idx array<int>, val array<double>").repartition(max(1, min(64, len(matrix) // 64)))
    return LatentIndex(passages, vocab, weights, randomised_svd(rows, len(vocab), min(rank, len(passages))), df)


def build_index(texts: DataFrame, items: list[tuple], rank: int = RANK) -> BlockIndex | None:
    """The index of a block of items (id, text); texts: (id, text as binary) of all documents."""
    passages = passages_of(items)
    if not passages:
        return None
    n, df = _frequencies(texts, {w for _, ws in passages for w in ws})
    spaces: dict[int, list] = {}
    for passage in passages:
        spaces.setdefault(passage[0] // LATENT_ITEMS, []).append(passage)
    return BlockIndex([_latent_index(texts.sparkSession, own, df, n, rank) for own in spaces.values()], CompactIndex(passages, df))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document row and benchmark item found in it: id_col, item_col, cosine, lcs_share, n_answers, first_word.

    Null texts hold nothing; items without words are found nowhere. Items of equal texts are searched once
    and found each for itself, a repeated row as often as it stands there, and repeated documents as often
    as they do; null ids stay null. An empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias(id_col), F.col(text_col).cast("binary").alias("__text"))
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("__own"), F.md5(F.col(item_text_col).cast("binary")).alias("__md5"), F.col(item_text_col).alias("text"))
    # equal items are searched once
    once = materialise(items.groupBy("__md5").agg(F.first("text").alias("text")), "benchmark-texts")
    n_blocks = max(1, -(-once.count() // block_items))
    kind = f"`{id_col}` {id_type}, __item long, cosine double, lcs_share double, n_answers int, first_word long"
    found = None
    for block in range(n_blocks):
        part = once.filter(F.pmod(F.xxhash64("__md5"), F.lit(n_blocks)) == block).orderBy("__md5").collect()  # about block_items rows
        index = build_index(texts, [(r["__md5"], r["text"]) for r in part])
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            index = shared.value
            release_memo()
            for b in batches:
                rows, cols = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for item, hit in index.search(words_of(text)).items():
                        rows.append(i)
                        cols.append((item, *hit))
                at = b.column(0).take(pa.array(rows, pa.int64()))
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([at, *(pa.array(c, k) for c, k in zip(zip(*cols) if cols else [()] * 5, kinds))], [id_col, "__item", "cosine", "lcs_share", "n_answers", "first_word"])

        names = spark.createDataFrame([(i, r["__md5"]) for i, r in enumerate(part)], "__item long, __md5 string")
        hits = texts.mapInArrow(search, kind).join(F.broadcast(names), "__item").drop("__item")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, `{item_col}` {item_type.simpleString()}, cosine double, lcs_share double, n_answers int, first_word long")
    named = found.withColumnRenamed(id_col, "__doc").join(items.drop("text"), "__md5")
    return named.select(F.col("__doc").alias(id_col), F.col("__own").alias(item_col), "cosine", "lcs_share", "n_answers", "first_word")
