"""Ranked lexical search over inverted treaps.

Index. Documents lie in segments, as Spark reads them: a task turns what it reads into segments of
bounded size, each a row with its documents in doc_id order and the postings of the terms that are
asked for. Frequencies for the weights are sums over segments, so nothing else is shuffled.

Treap. A term's postings in a segment are a binary tree: search order by doc_id, heap order by impact
(the term's part of a score). A node holds the postings of BUCKET neighbouring documents and the largest
impact among them; with BUCKET = 1 it is a single posting.

Search. The trees of an item's terms are walked at once. A state is a range of documents with the top
node of each term in it; the sum of their impacts bounds every score in the range. The state of the
highest bound is cut at the node of the largest impact: documents there are scored, and both sides
become states, unless their bound can't enter the best k. The best k of one segment prune the next of
the same task, and only a task's best k leave it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicledger.llm.common import folding, materialise, release_memo, terms_of

#: Neighbouring documents of a node.
BUCKET = 64
#: Postings, and documents, of a segment at most, but for a single document of more.
SEGMENT_POSTINGS, SEGMENT_DOCS = 400_000, 16_384
#: Terms of the items that are broadcast together, repeated ones counted, but for a single item of more.
BLOCK_TERMS = 200_000
#: Parts of the score.
SCALE, SATURATION, FLAT, LENGTH = 1_000_000_000, 8, 10, 90
SEGMENT = "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms binary, docs binary, counts binary, term_df array<struct<term: int, df: long>>"


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _segment(ids: list, lengths: list[int], found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """Documents and (term, count) of each as a row of SEGMENT, by doc_id; null ids first."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    term = np.array([t for i in order for t, _ in found[i]], np.int32)
    count = np.array([c for i in order for _, c in found[i]], np.int64)
    doc = np.repeat(np.arange(len(order), dtype=np.int32), [len(found[i]) for i in order])
    by_term = np.lexsort((doc, term))
    there, df = np.unique(term, return_counts=True)
    kind = pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())]))
    return pa.RecordBatch.from_arrays([
        pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
        pa.array([np.array([lengths[i] for i in order], np.int64).tobytes()], pa.binary()), pa.array([term[by_term].tobytes()], pa.binary()),
        pa.array([doc[by_term].tobytes()], pa.binary()), pa.array([count[by_term].tobytes()], pa.binary()),
        pa.array([[{"term": t, "df": d} for t, d in zip(there.tolist(), df.tolist())]], kind)], [x.split()[0] for x in SEGMENT.split(", ")[:7]] + ["term_df"])


def index_segments(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Rows of SEGMENT for all documents: the postings of the vocabulary, and the lengths of whole texts."""
    fold = folding(digits=True)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches):
        release_memo()
        number, ids, lengths, found, held = shared.value, [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words: Counter = Counter()
                for part in terms_of(text, fold):
                    words.update(part)
                own = [(number[w], c) for w, c in words.items() if w in number]
                if ids and (held + len(own) > SEGMENT_POSTINGS or len(ids) >= SEGMENT_DOCS):
                    yield _segment(ids, lengths, found)
                    ids, lengths, found, held = [], [], [], 0
                ids.append(doc)
                lengths.append(words.total())
                found.append(own)
                held += len(own)
        if ids:
            yield _segment(ids, lengths, found)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(index, SEGMENT)


class Treaps:
    """The treaps of a segment's terms, and the search over them."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray, counts: np.ndarray, weights: dict[int, int], n: int, total: int, bucket: int = BUCKET):
        self.bucket = bucket
        penalty = np.array([FLAT + LENGTH * x * n // total if total else FLAT for x in lengths.tolist()], np.int64)
        of_term = np.array([weights[t] for t in np.unique(terms).tolist()], np.int64)
        number = np.unique(terms, return_inverse=True)[1]
        self.docs = docs
        self.impacts = (of_term[number] if len(terms) else np.zeros(0, np.int64)) * ((SCALE * counts) // (1000 * counts + SATURATION * penalty[docs]))
        # a node for each term and bucket of documents
        self.buckets = -(-len(lengths) // bucket)
        keys = terms.astype(np.int64) * self.buckets + docs // bucket
        self.starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.ends = np.r_[self.starts[1:], len(keys)] if len(keys) else self.starts
        self.keys = keys[self.starts]
        self.tops: list[int] = np.maximum.reduceat(self.impacts, self.starts).tolist() if len(keys) else []
        of_node = self.keys // self.buckets if self.buckets else self.keys
        self.at: list[int] = (self.keys - of_node * self.buckets).tolist()
        first = np.flatnonzero(np.r_[True, of_node[1:] != of_node[:-1]]) if len(of_node) else np.zeros(0, np.int64)
        self.left, self.right = [-1] * len(self.tops), [-1] * len(self.tops)
        self.roots = {t: self._tree(lo, hi) for t, lo, hi in zip(of_node[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of_node)])}

    def _tree(self, lo: int, hi: int) -> int:
        """Builds a term's tree over its nodes, which lie by document; returns its root."""
        tops, left, right, spine = self.tops, self.left, self.right, []
        for i in range(lo, hi):
            below = -1
            while spine and tops[spine[-1]] < tops[i]:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        return spine[0]

    def search(self, terms: list[int], best: list[tuple[int, int, int]], k: int, order: list[int], segment: int) -> int:
        """Puts what belongs there into best, a heap of (score, -order of doc_id, -(segment, place)) of k entries at most. Returns how many nodes were scored."""
        tops, at, left, right, roots = self.tops, self.at, self.left, self.right, self.roots
        nodes = [roots[t] for t in terms if t in roots]
        if not nodes:
            return 0
        base = np.array([t for t in terms if t in roots], np.int64) * self.buckets
        states, made, scored = [(-sum(tops[v] for v in nodes), 0, 0, self.buckets, nodes)], 0, 0
        while states:
            bound, _, lo, hi, nodes = heapq.heappop(states)
            if -bound < (best[0][0] if len(best) == k else 1):
                break  # no other state has a higher bound
            b = at[max(nodes, key=tops.__getitem__)]
            self._score(b, base, best, k, order, segment)
            scored += 1
            least = best[0][0] if len(best) == k else 1
            for low, high in ((lo, b), (b + 1, hi)):
                if low == high:
                    continue
                inside, bound = [], 0
                for v in nodes:
                    while v >= 0:
                        x = at[v]
                        if x >= high:
                            v = left[v]
                        elif x < low:
                            v = right[v]
                        else:
                            inside.append(v)
                            bound += tops[v]
                            break
                if inside and bound >= least:
                    made += 1
                    heapq.heappush(states, (-bound, made, low, high, inside))
        return scored

    def _score(self, b: int, base: np.ndarray, best: list, k: int, order: list[int], segment: int) -> None:
        """Scores all documents of a bucket, exactly."""
        keys = base + b
        where = np.searchsorted(self.keys, keys)
        where = where[self.keys[np.minimum(where, len(self.keys) - 1)] == keys]
        starts, sizes = self.starts[where], self.ends[where] - self.starts[where]
        place = np.arange(sizes.sum()) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        scores = np.zeros(self.bucket, np.int64)
        np.add.at(scores, self.docs[place] - b * self.bucket, self.impacts[place])
        for x in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
            doc = b * self.bucket + x
            entry = (int(scores[x]), -order[doc], -(segment << 32 | doc))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, item, id, terms): different items (id, text), dealt into blocks of at most BLOCK_TERMS terms."""
    fold = folding(digits=True)

    def cut(batches):
        release_memo()
        part, seq, held, k = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                own = sorted({w for words in terms_of(text, fold) for w in words})
                if held and held + len(own) > BLOCK_TERMS:
                    seq, held = seq + 1, 0
                held += len(own)
                rows.append((part << 32 | seq, part << 32 | k, own))
                k += 1
            block, item, terms = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(item, pa.int64()), b.column(0), pa.array(terms, pa.list_(pa.binary()))], ["block", "item", "id", "terms"])

    once = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    kind = items.schema[id_col].dataType.simpleString()
    return materialise(once.repartition(1 + size // (8 * BLOCK_TERMS)).mapInArrow(cut, f"block long, item long, id {kind}, terms array<binary>"), "search-items")


def search_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, bucket: int = BUCKET) -> DataFrame:
    """item_col, rank, id_col, score: the k documents of the highest scores above 0 for each item; equal scores by ascending id, null ids first.

    Null and empty texts hold no terms: as documents they are no hits, as items they have none. Equal items
    (id and text) are one; items that share an id but not the text are ranked each for itself. Repeated
    documents are ranked as often as they stand there. Other columns are ignored, whatever their names.
    An empty table on either side gives no rows. A text may have any length.

    The items go in blocks of bounded size; for each, the documents are read once and the index of the
    block's terms is written and searched.
    """
    spark = docs.sparkSession
    item_type, id_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    table = _blocks(items, item_col, item_text_col)
    found = None
    for block in sorted(r["block"] for r in table.select("block").distinct().collect()):
        part = table.filter(F.col("block") == block).select("item", "terms").collect()  # at most BLOCK_TERMS terms, or one item
        words = sorted({bytes(w) for r in part for w in r["terms"]})
        vocabulary = {w: i for i, w in enumerate(words)}
        asked = [(r["item"], [vocabulary[bytes(w)] for w in r["terms"]]) for r in part if r["terms"]]
        if not asked:
            continue
        segments = materialise(index_segments(docs, vocabulary, id_col, text_col), "search-segments")
        n, total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = segments.select(F.inline("term_df")).groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most the block's terms
        shared = spark.sparkContext.broadcast((asked, {r["term"]: weight(n, r["df"]) for r in df}, n, total))

        def search(batches, shared=shared):
            release_memo()
            asked, weights, n, total = shared.value
            best: dict[int, list] = {item: [] for item, _ in asked}
            ids: dict[int, int | None] = {}
            segment = 0
            for b in batches:
                for own, *cells in zip(b.column(0), *(b.column(i).to_pylist() for i in range(1, 5))):
                    own, lengths, terms, docs, counts = own.as_py(), *(np.frombuffer(x, t) for x, t in zip(cells, (np.int64, np.int32, np.int32, np.int64)))
                    trees = Treaps(lengths, terms, docs, counts, weights, n, total, bucket)
                    order = [-(1 << 63) if x is None else x for x in own]
                    for item, wanted in asked:
                        trees.search(wanted, best[item], k, order, segment)
                    # ids of what may still be among the best
                    for heap in best.values():
                        ids.update((at, own[-at & 0xFFFFFFFF]) for _, _, at in heap if -at >> 32 == segment)
                    segment += 1
            rows = [(item, ids[at], score) for item, heap in best.items() for score, _, at in heap]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], ["item", "doc", "score"])

        hits = segments.select("doc_ids", "lengths", "terms", "docs", "counts").mapInArrow(search, "item long, doc long, score long")
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"`{item_col}` {item_type.simpleString()}, rank int, `{id_col}` {id_type.simpleString()}, score long")
    named = table.select("item", F.col("id").alias("__id")).join(found, "item")
    return named.select(F.col("__id").alias(item_col), "rank", F.col("doc").cast(id_type).alias(id_col), "score")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
items AS (SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
whole AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM docs WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, len(terms)::BIGINT AS own, unnest(terms) AS term FROM docs),
post AS (SELECT r, doc_id, own, term, count(*)::BIGINT AS tf FROM tf WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, whole GROUP BY term, n),
parts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * own * n) // l)))) AS part FROM post JOIN weights USING (term), whole),
scores AS (SELECT item_id, text, r, doc_id, sum(part)::BIGINT AS score FROM items JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM scores QUALIFY rank <= 10
"""
