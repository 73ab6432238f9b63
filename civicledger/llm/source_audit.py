"""Divergence of sources within a language, by joint count histograms.

A language's vocabulary is what stands in enough of its documents. Two sources are compared over all of
it without visiting it: for each pair the distinct combinations (count here, count there) are tallied,
and the divergence is evaluated once for each combination and multiplied by how often it occurs.
Combinations with a zero are implied by the counts of one source alone: how often it has a count, less how
often the other source has the term as well; and (0, 0) is what remains of the vocabulary.

Words are counted where the text is read, by language and source, so a frequent word leaves a task as one
row for each source. A term's sources stand in one array, no longer than a language has sources.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicledger.llm.common import folding, materialise, release_memo, terms_of

#: Sums of a task that are let go together, to bound a worker's memory.
HELD = 400_000

def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, by task; a row with an empty term for every group that a task has."""
    fold = folding(digits=False)

    def count(batches):
        release_memo()
        n: dict[tuple, Counter] = {}
        d: dict[tuple, Counter] = {}

        def let_go():
            for key, words in n.items():
                words[b""] = 0
                size, of = len(words), d[key]
                yield pa.RecordBatch.from_arrays([
                    pa.array([key[0]] * size, pa.string()), pa.array([key[1]] * size, pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64()), pa.array([of[w] for w in words], pa.int64())],
                    ["lang", "source", "term", "n", "d"])
            n.clear()
            d.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, seen = n.setdefault((lang, source), Counter()), d.setdefault((lang, source), Counter())
                held -= len(words)
                own: set[bytes] = set()
                for part in terms_of(text, fold):
                    words.update(part)
                    own.update(part)
                seen.update(own)
                held += len(words)
                if held > HELD:
                    yield from let_go()
                    held = 0
        yield from let_go()

    return docs.mapInArrow(count, "lang string, source string, term binary, n long, d long")


def _share(count: Column, total: Column, terms: Column, add: int, scale: int) -> Column:
    """1 + floor(scale * (count + add) / (total + add * terms)), in decimals that hold any count."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = F.lit(scale).cast("decimal(10,0)") * wide(count + add), wide(total + add * terms)
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, top: int = 50, add: int = 5, scale: int = 1_000_000_000) -> DataFrame:
    """lang, source, part, item, value, rank. Part 'pair': every other source of the language and how far it is, by rank; part 'term': the terms that the source has most beyond its language.

    Every row is a document, repeated ones too. Null texts, languages and sources are empty ones; a group without
    terms has rows as any other; a language without vocabulary has pairs of value 0. Equal values rank by item,
    as bytes. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = _counts(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text")))
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("d").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    marks = F.octet_length("term") == 0
    by_term = by_term.filter(marks | (F.col("df") >= least_docs)).select("lang", F.col("term").cast("string").alias("term"), "n", F.array_sort("cells").alias("cells"))
    by_term = materialise(by_term, "audit-terms")
    kept = by_term.filter("term <> ''")
    cells = kept.select("lang", "term", F.col("n").alias("all_n"), F.explode("cells").alias("c")).select("lang", "term", "all_n", "c.source", "c.n")

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    in_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("present"))
    groups = by_term.filter("term = ''").select("lang", F.explode("cells.source").alias("source")).join(of_lang, "lang", "left").join(in_group, ["lang", "source"], "left").na.fill(0)
    groups = materialise(groups, "audit-groups")

    pairs = _pairs(kept, cells, groups, add, scale)
    p, q = _share(F.col("n"), F.col("group_n"), F.col("terms"), add, scale), _share(F.col("all_n"), F.col("lang_n"), F.col("terms"), add, scale)
    typical = cells.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(typical.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame, add: int, scale: int) -> DataFrame:
    """Part 'pair' without ranks, both ways."""
    g = lambda x: groups.select("lang", "terms", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "group_n", "present")))
    pair = g("a").join(g("b").drop("terms"), "lang").filter("source_a < source_b")
    key = ["lang", "source_a", "source_b"]
    # both have the term
    first = kept.select("lang", "cells", F.posexplode("cells").alias("at", "a"))
    both = first.select("lang", "a", F.explode(F.slice("cells", F.col("at") + 2, F.size("cells"))).alias("b"))
    both = both.select("lang", F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    joint = both.groupBy(*key, "n_a", "n_b").agg(F.count("*").alias("times"))
    zero, cell = F.lit(0).cast("long"), lambda a, b, times: F.struct(a.alias("n_a"), b.alias("n_b"), times.alias("times"))
    n_a, n_b, times = F.col("n_a"), F.col("n_b"), F.col("times")
    # what stands in both is taken from what one source has alone, and given back to what neither has
    shared = joint.select(*key, F.inline(F.array(cell(n_a, n_b, times), cell(n_a, zero, -times), cell(zero, n_b, -times), cell(zero, zero, times))))
    hist = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    own = lambda x, a, b: pair.select(*key).join(hist.withColumnRenamed("source", f"source_{x}"), ["lang", f"source_{x}"]).select(*key, a.alias("n_a"), b.alias("n_b"), "times")
    neither = pair.select(*key, zero.alias("n_a"), zero.alias("n_b"), (F.col("terms") - F.col("present_a") - F.col("present_b")).alias("times"))
    tally = shared.unionByName(own("a", F.col("n"), zero)).unionByName(own("b", zero, F.col("n"))).unionByName(neither)
    tally = tally.groupBy(*key, "n_a", "n_b").agg(F.sum("times").alias("times")).filter("times > 0")
    away = F.abs(_share(n_a, F.col("group_n_a"), F.col("terms"), add, scale) - _share(n_b, F.col("group_n_b"), F.col("terms"), add, scale))
    sums = tally.join(pair, key).groupBy(*key).agg(F.sum(away * times).alias("value"))
    done = pair.select(*key).join(sums, key, "left").na.fill(0)
    one = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    out = done.select("lang", "value", F.inline(F.array(one("source_a", "source_b"), one("source_b", "source_a"))))
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
vocab AS (SELECT lang, term, count(*) AS all_n FROM docs GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
cells AS (SELECT d.lang, d.source, d.term, count(*) AS n FROM docs d JOIN vocab USING (lang, term) GROUP BY 1, 2, 3),
of_lang AS (SELECT lang, count(*) AS v, sum(all_n) AS n FROM vocab GROUP BY 1),
groups AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) g
  LEFT JOIN of_lang l USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
every AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (t.all_n + 5)) // (g.lang_n + 5 * g.v)::HUGEINT AS q
  FROM groups g JOIN vocab t USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM every WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 50
"""
