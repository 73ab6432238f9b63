"""Exact n-gram Jaccard self-join into connected components, by a forest of signature trees.

Upper levels, dealt by Spark. A document's set of word n-grams belongs to a size class, and within
the class its members are dealt by hash into a fixed number of parts, one more than two linked sets
can differ in. So linked sets agree wholly in some part; documents are routed by (class, part,
contents of the part), and those that meet there form a block. No frequencies are needed, and a
passage that many documents share makes no large block unless it fills a whole part.

Links that come cheap. Equal sets collapse to one node first. Each node is then compared with the
smallest node that it meets in any block; the components of these links are known before the trees
are built, so a block of thousands of near copies is settled by one comparison a document.

Crowds. Texts from one template may each miss the smallest and yet hang together. Blocks that hold
more than CROWD documents of several components are therefore asked first, in up to ROUNDS rounds,
for each document's nearest few of other components by bitmap; what these comparisons link is one
component from then on. Their number grows with the documents, not with the pairs.

Lower levels. Only blocks that still hold several components get a tree: its nodes hold OR-combined
token bitmaps, size ranges and the component, if it is one. A dual traversal discards node pairs of
one component and pairs whose largest possible overlap is too small for their sizes; leaf pairs that
are left are compared exactly. Blocks beyond CELL documents are cut into cells of two chunks, so no
task holds a whole one.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.llm.common import connected_components, materialise, release_memo, without_ids

#: Documents of a tree at most; larger blocks are cut into chunks that meet in pairs.
CELL = 512
LEAF = 8
#: Members of a set that gets a sparse bitmap.
SMALL = 256
FAN = 4
#: Open blocks of more documents are joined by nearest partners first; the result is the same without.
CROWD = 32
#: Partners of a document in a cell whose comparison such a round asks for, and rounds at most.
NEAREST, ROUNDS = 1, 3
#: Smallest signatures of a document that go with it, by which most pairs are compared once although they meet often.
LEADING = 8
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words, if there are fewer; none without words."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    acc = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * _M1 + ids[j : len(words) - width + 1 + j]
    return np.unique(_mix(acc))


class Routing:
    """Size classes and parts for links of 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be between 50 and 100")
        self.percent = percent
        ratio = 1.5 if percent >= 85 else 1.25
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, ceil(self.lows[-1] * ratio)))
        # methods are cached per object
        self.parts = lru_cache(maxsize=None)(self._parts)

    def __reduce__(self):
        return Routing, (self.percent,)

    def size_class(self, n: int) -> int:
        return bisect_right(self.lows, n) - 1

    def _parts(self, c: int) -> tuple[int, int]:
        """(parts, how many of them may be empty) of a class: linked sets of which the smaller is in it agree in more than that many."""
        low, high = self.lows[c], self.lows[c + 1] - 1
        differ = high * (100 - self.percent) // self.percent
        if not differ:
            return 1, 0
        spare = 0
        for _ in range(20):
            m = differ + 1 + spare
            mean = m * exp(-low / m)
            again = ceil(mean + 3 * sqrt(mean))
            if again <= spare:
                break
            spare = again
        return differ + 1 + spare, spare

    def classes(self, n: int) -> list[int]:
        """Classes in which a set of n meets its partners: its own, and those of the smaller ones that it may be linked with."""
        return list(range(self.size_class(max(1, -(-n * self.percent // 100))), self.size_class(n) + 1))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        out = []
        for c in self.classes(len(s)) if len(s) else ():
            m, spare = self.parts(c)
            if m == 1:
                continue  # only equal sets are linked
            part = (s % np.uint64(m)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            there, starts = np.unique(part[order], return_index=True)
            sums = np.add.reduceat(_mix(s + _M1)[order], starts)
            if m - len(there) > spare:
                empty = np.setdiff1d(np.arange(m), there)
                there, sums = np.r_[there, empty], np.r_[sums, np.zeros(len(empty), np.uint64)]
            out.append(_mix(sums + _M1 * np.array([c + 1], np.uint64) + _M2 * (there.astype(np.uint64) + np.uint64(1))))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each member, a power of two of them in 64-bit words: at least four for each member, 32 in sets of up to SMALL.

    Clusters of short texts that miss the threshold narrowly need the sparse ones: collisions would let all their pairs through.
    """
    bits = 1 << max(6, int((32 if len(s) <= SMALL else 4) * max(1, len(s)) - 1).bit_length())
    at = _mix(s) & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at % np.uint64(bits // 64)).astype(np.int64), np.uint64(1) << (at // np.uint64(bits // 64)))
    return out


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """The same bitmap with fewer words (a bit's word is its place modulo the words)."""
    return np.bitwise_or.reduce(b.reshape(-1, words), axis=0) if len(b) > words else b


class SignatureTree:
    """Leaves of documents sorted by component and size; every level's nodes cover FAN of the level below."""

    def __init__(self, sizes: np.ndarray, comps: np.ndarray, maps: np.ndarray, percent: int):
        self.percent = percent
        slack = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack, comps)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack, comps = self.levels[-1]
            at = np.arange(0, len(maps), width)
            c_low, c_high = np.minimum.reduceat(comps, at), np.maximum.reduceat(comps, at)
            self.levels.append((
                np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(slack, at), np.where(c_low == c_high, c_low, -1),
            ))
            width = FAN

    def _alive(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of a level that may hold a link between components: by the largest overlap that bitmaps and sizes allow."""
        maps, low, high, slack, comps = self.levels[level]
        ok = (comps[x] < 0) | (comps[x] != comps[y])
        out = np.zeros(len(x), bool)
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 65536):
            i = at[k : k + 65536]
            a, b = x[i], y[i]
            common = np.bitwise_count(maps[a] & maps[b]).sum(axis=1).astype(np.int64)
            most = np.minimum(common + np.minimum(slack[a], slack[b]), np.minimum(high[a], high[b]))
            out[i] = most * (100 + self.percent) >= self.percent * (low[a] + low[b])
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents (x < y) of different components that may be linked."""
        top = len(self.levels) - 1
        x = y = np.zeros(1, np.int64)
        for level in range(top, 0, -1):
            alive = self._alive(level, x, y)
            x, y = x[alive], y[alive]
            below, width = len(self.levels[level - 1][0]), LEAF if level == 1 else FAN
            i, j = np.divmod(np.arange(width * width), width)
            x, y = (x[:, None] * width + i).ravel(), (y[:, None] * width + j).ravel()
            inside = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
            x, y = x[inside], y[inside]
        alive = self._alive(0, x, y) & (x < y) & (self.levels[0][4][x] != self.levels[0][4][y])
        return x[alive], y[alive]


    def nearest(self, x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs those in which one is among the other's n nearest, by the share of the bits that both have."""
        maps, sizes = self.levels[0][:2]
        near = np.zeros(len(x))
        for k in range(0, len(x), 65536):
            a, b = x[k : k + 65536], y[k : k + 65536]
            near[k : k + 65536] = np.bitwise_count(maps[a] & maps[b]).sum(axis=1) / (sizes[a] + sizes[b])
        kept = np.zeros(len(x), bool)
        for side in (x, y):
            order = np.lexsort((-near, side))
            _, starts, counts = np.unique(side[order], return_index=True, return_counts=True)
            kept[order[np.arange(len(order)) - np.repeat(starts, counts) < n]] = True
        return x[kept], y[kept]


def _block_pairs(nodes: np.ndarray, comps: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int, nearest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the documents that may be linked, by the tree over a block; of each only the nearest few, if asked so."""
    order = np.lexsort((nodes, sizes, comps))
    raw = [np.frombuffer(maps[i], "<u8") for i in order]
    words = min(map(len, raw))
    if len(order) == 2:
        sizes = sizes[order]
        a, b = (fold(m, words) for m in raw)
        common = int(np.bitwise_count(a & b).sum())
        most = min(common + min(int(n) - int(np.bitwise_count(m).sum()) for n, m in zip(sizes, (a, b))), int(sizes.min()))
        if comps[0] == comps[1] or most * (100 + percent) < percent * int(sizes.sum()):
            return order[:0], order[:0]
        return order[:1], order[1:]
    dense = {c: i for i, c in enumerate(dict.fromkeys(comps[order].tolist()))}
    comp = np.array([dense[c] for c in comps[order].tolist()])
    tree = SignatureTree(sizes[order], comp, np.stack([fold(m, words) for m in raw]), percent)
    x, y = tree.pairs()
    if nearest is not None:
        x, y = tree.nearest(x, y, nearest)
    return order[x], order[y]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))

    def check(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * common >= percent * (len(both) - common):
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_col (a whole number), n_shingles, component_id.

    Null and blank texts have no shingles and are linked with nothing, not even each other. Several
    rows of one id are one document with several texts: what any of them is linked with, the id is.
    A row with a null id has a count and a null component. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    route = Routing(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def sign(batches):
        from xxhash import xxh3_128_digest

        release_memo()
        for b in batches:
            sizes, prints, sigs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, k)
                sizes.append(len(s))
                prints.append(xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None)
                sigs.append(route.signatures(s).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "n", "fp", "sigs"])

    signed = materialise(rows.mapInArrow(sign, "id long, n long, fp binary, sigs array<long>"), "shingle-signatures")
    usable = signed.filter("id IS NOT NULL AND fp IS NOT NULL")
    groups = materialise(usable.groupBy("fp").agg(F.min("id").alias("node")), "shingle-groups")
    firsts = usable.filter(F.size("sigs") > 0).join(groups.withColumnRenamed("fp", "g"), (F.col("fp") == F.col("g")) & (F.col("id") == F.col("node")))
    # the aggregation combines before it shuffles, and a plain join is one whose skewed keys Spark can split
    postings = firsts.select("node", F.explode("sigs").alias("sig"))
    # most signatures are in one document only: a count finds the others with the narrowest shuffle, and what is asked of those is asked of few rows
    repeated = materialise(postings.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig"), "shingle-repeated")
    met = materialise(postings.join(repeated, "sig"), "shingle-met")
    blocks = met.groupBy("sig").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").select("sig", "lead")
    meetings = materialise(met.join(materialise(blocks, "shingle-blocks"), "sig"), "shingle-meetings")
    wanted = meetings.select("node").distinct()

    def members(batches):
        for b in batches:
            found = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(map(len, found), pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary()),
                pa.array([bitmap(s).astype("<u8").tobytes() for s in found], pa.binary()),
                pa.array([np.sort(route.signatures(s).view(np.int64))[:LEADING].astype("<i8").tobytes() for s in found], pa.binary())], ["node", "n", "members", "bits", "own"])

    texts = rows.filter("id IS NOT NULL").join(wanted, F.col("id") == F.col("node"), "left_semi")
    sets = materialise(texts.mapInArrow(members, "node long, n long, members binary, bits binary, own binary").dropDuplicates(["node", "members"]), "shingle-sets")
    cheap = meetings.filter("node <> lead").groupBy("node").agg(F.min("lead").alias("lead")).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    links = materialise(_verified(cheap, sets, percent), "shingle-links")
    known = connected_components(links)

    def traverse(nearest: int | None):
        def run(batches):
            held: list = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if held and held[0][:3] != r[:3]:
                        yield from _cell(held, percent, nearest)
                        held = []
                    held.append(r)
            if held:
                yield from _cell(held, percent, nearest)

        return run

    def candidates(cells: DataFrame, nearest: int | None) -> DataFrame:
        """Pairs of the cells (sig, i, j, mine, node, component) that may be linked."""
        full = cells.join(sets.select("node", "n", "bits", "own" if nearest is None else F.lit(None).cast("binary").alias("own")), "node")
        dealt = full.select("sig", "i", "j", "mine", "node", "component", "n", "bits", "own").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        return dealt.mapInArrow(traverse(nearest), "a long, b long").distinct()

    def place(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(sig, node, component) of the meetings, and the blocks that hold several components yet."""
        placed = meetings.select("sig", "node").join(known, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        placed = materialise(placed, "shingle-placed")
        blocks = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("sig", "size")
        return placed, materialise(blocks, "shingle-open")

    cut = F.ceil(F.col("size") / CELL).cast("int")
    placed, open_blocks = place(known)
    for _ in range(ROUNDS):
        crowds = open_blocks.filter(F.col("size") > CROWD)
        if crowds.isEmpty():
            break
        # each block deals its documents into chunks in its own way, so what one keeps apart meets in another
        chunk = F.pmod(F.xxhash64("sig", "node"), cut).cast("int")
        cells = placed.join(crowds, "sig").withColumn("mine", chunk).select("sig", F.col("mine").alias("i"), F.col("mine").alias("j"), "mine", "node", "component")
        near = materialise(_verified(materialise(candidates(cells, NEAREST), "shingle-near"), sets, percent), "shingle-near-links")
        if near.isEmpty():
            break
        links = links.unionByName(near)
        known = connected_components(links)
        placed, open_blocks = place(known)
    cells = placed.join(open_blocks, "sig").withColumn("cut", cut).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    cells = cells.select("sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "component")
    more = _verified(materialise(candidates(cells, None), "shingle-candidates"), sets, percent)
    # an id with several texts joins their groups
    several = usable.select("id", "fp").distinct().groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    own = usable.join(several, "id", "left_semi").join(groups, "fp").filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    components = connected_components(links.unionByName(more).unionByName(own))
    label = groups.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    found = signed.select("id", "n", "fp").join(label, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), component.cast(id_type).alias("component_id"))


def _cell(rows: list, percent: int, nearest: int | None = None):
    """The pairs of a cell, or of each document those with its nearest few. Two documents meet in every signature that they share, and in several cells of one chunk: they count in the
    cell of their two chunks alone, and nowhere where their smallest signatures show a smaller common one."""
    sig, i, j = rows[0][:3]
    mine, nodes, comps, sizes = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6))
    if len(rows) > 1:
        x, y = _block_pairs(nodes, comps, sizes, [r[7] for r in rows], percent, nearest)
        here = nodes[x] != nodes[y]
        if i != j:
            here &= mine[x] != mine[y]
        x, y = x[here], y[here]
        if nearest is not None:  # a pair that is nearest in several blocks is told once by what reads the pairs
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(nodes[x], nodes[y])), pa.array(np.minimum(nodes[x], nodes[y]))], ["a", "b"])
            return
        own = {k: np.frombuffer(rows[k][8], "<i8") for k in np.union1d(x, y).tolist()}
        first = np.array([not (np.intersect1d(own[a], own[b], assume_unique=True) < sig).any() for a, b in zip(x.tolist(), y.tolist())], bool)
        x, y = nodes[x[first]], nodes[y[first]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that aren't the smallest id of their component; rows with a null id stay."""
    found = jaccard_components(docs, id_col, text_col, k, percent)
    return without_ids(docs, found.filter(F.col(id_col) != F.col("component_id")), id_col)
