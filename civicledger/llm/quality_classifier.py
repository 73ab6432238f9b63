"""Document classifier with site posteriors by hierarchical empirical Bayes.

A logistic model over words and coarse surface features, fitted on a bounded sample of the labels,
gives each document evidence (log odds beyond the prior's) of low quality and of toxicity. Grouped sums of
the resulting probabilities over all documents give each host and each path of a host a rate; sparse
paths shrink to their host and sparse hosts to the global rate, by strengths that the method of
moments estimates from the grouped sums themselves. A document's evidence then meets its path's
posterior rate, its own share left out, instead of one global prior.

Evidence is computed once in a map-only pass. Sites are aggregated with partial sums, so a host with
a third of all rows is a few rows after the map side.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.llm.common import materialise, release_memo

#: Bounds of the fit: labelled rows, and features that the model keeps.
MAX_LABELLED = 20_000
MAX_FEATURES = 2_000
#: A feature must stand in so many labelled documents, and differ between classes by so many standard errors.
MIN_SUPPORT = 5
MIN_Z = 4.0
CLASSES = ("low_quality", "toxic")
THRESHOLD = 0.5

_PUNCTUATION = ".,;:!?\"'()[]{}«»„“”…"
_SYMBOLS = set("#*$%&|<>")


def features(text: str) -> set[str]:
    """Lower-case words and, marked by a tab, coarse surface features."""
    tokens = text.split()
    n = len(tokens)
    out = {w.strip(_PUNCTUATION) for w in set(text.lower().split())}
    out.discard("")
    if n:
        def share(name: str, k: int) -> None:
            out.add(f"\t{name}{0 if k == 0 else 1 + sum(100 * k >= c * n for c in (2, 5, 10, 20, 40, 70))}")

        share("bang", text.count("!!"))
        share("bar", tokens.count("|"))
        share("symbol", sum(text.count(c) for c in _SYMBOLS))
        share("upper", sum(map(str.isupper, tokens)))
        share("digit", sum(map(str.isdigit, tokens)))
        share("stop", text.count(".") + text.count("!") + text.count("?"))
        share("repeat", n - len(set(tokens)))
        lines = [x for x in text.split("\n") if x]
        share("line", n * (len(lines) - len(set(lines))) // max(1, len(lines)))
        out.add(f"\tlength{min(14, n.bit_length())}")
        out.add(f"\tword{min(15, len(text) // n)}")
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> tuple[dict[str, tuple[float, float]], tuple[float, float]]:
    """({feature: weight for each class; "\\t": the intercept beyond the prior}, rate of each class) from at most max_labelled labelled documents.

    Labels with a null go; several of one document count as bad if any is. The sample is the labels of
    smallest hash, so it doesn't depend on how rows are dealt.
    """
    known = labels.select(F.col(id_col).alias("__id"), (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna()
    known = known.groupBy("__id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "__id")
    # a labelled id may have any number of rows: its text of smallest hash stands for it, so the fit has as many rows as labels
    rows = rows.groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("low").alias("low"), F.first("toxic").alias("toxic"))
    rows = materialise(rows.select("text", "low", "toxic"), "labelled")

    def count(batches):
        release_memo()
        n, low, toxic = Counter(), Counter(), Counter()
        for b in batches:
            for text, is_low, is_toxic in zip(*(c.to_pylist() for c in b.columns)):
                found = features(text)
                found.add("\t")
                n.update(found)
                if is_low:
                    low.update(found)
                if is_toxic:
                    toxic.update(found)
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (n, low, toxic))], ["feature", "n", "low", "toxic"])

    counts = rows.mapInArrow(count, "feature string, n long, low long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts.filter(F.col("n") >= MIN_SUPPORT), "classifier-counts")
    all_rows = counts.filter("feature = '\t'").select("n", "low", "toxic").first()
    if all_rows is None:
        return {}, (0.0, 0.0)
    total, sizes = all_rows["n"], (all_rows["low"], all_rows["toxic"])

    def z(hits: str, size: int):
        """Standard errors between the rate among a class and among the rest."""
        rest = max(1, total - size)
        p, q = F.col(hits) / F.lit(max(1, size)), (F.col("n") - F.col(hits)) / F.lit(rest)
        pooled = F.col("n") / F.lit(total)
        return (p - q) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * F.lit(1 / max(1, size) + 1 / rest))

    scored = counts.filter("feature <> '\t'").withColumn("z0", z("low", sizes[0])).withColumn("z1", z("toxic", sizes[1]))
    best = scored.withColumn("z", F.greatest(F.abs("z0"), F.abs("z1"))).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(max_features).collect()
    index = {r["feature"]: i for i, r in enumerate(best)}

    def select(batches):
        for b in batches:
            found = [[index[f] for f in index.keys() & features(t)] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1), b.column(2)], ["found", "low", "toxic"])

    # the bounded sample as feature numbers; ordered, as the sums of the fit depend on the order
    fitted = rows.mapInArrow(select, "found array<int>, low int, toxic int").toArrow()
    order = sorted(zip(*(fitted.column(k).to_pylist() for k in ("found", "low", "toxic"))), key=lambda r: (sorted(r[0]), r[1:]))
    low, toxic = (logistic([r[0] for r in order], [r[k] for r in order], len(index)) for k in (1, 2))
    weights = {f: (low[0][i], toxic[0][i]) for f, i in index.items()}
    weights["\t"] = (low[1] - logit(sizes[0] / total), toxic[1] - logit(sizes[1] / total))
    return weights, (sizes[0] / total, sizes[1] / total)


def logistic(rows: list[list[int]], labels: list[int], width: int, penalty: float = 1.0, steps: int = 400) -> tuple[list[float], float]:
    """Weights and intercept of an L2-penalised logistic regression on sets of features, by accelerated gradient descent."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], dtype=np.int64)
    y = np.asarray(labels, float)
    # features are scaled to unit curvature, else frequent ones set the step for all
    freq = np.bincount(cols, minlength=width) / max(1, n)
    scale = 1 / np.sqrt(np.maximum(freq * (1 - freq), 1e-3))
    longest = max(1.0, float(np.bincount(at, weights=scale[cols] ** 2, minlength=n).mean())) if n else 1.0
    w, b, w0, b0 = np.zeros(width), 0.0, np.zeros(width), 0.0
    for k in range(steps if n else 0):
        m = k / (k + 3)
        v, c = w + m * (w - w0), b + m * (b - b0)
        error = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=(v * scale)[cols], minlength=n) + c, -30, 30))) - y
        grad = np.bincount(cols, weights=error[at], minlength=width) * scale / n + penalty * v / n
        w0, b0 = w, b
        w, b = v - 4 / (longest + 1) * grad, c - 4 / (longest + 1) * error.mean()
    return (w * scale).tolist(), float(b)


def logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """Sums by path from rows with __host, __path and a probability p_<class> each, and {class: (rate, strength of hosts, of paths)}.

    A row per path: __host, __path, n and s_<class> of the path, hn and h_<class> of its host.
    """
    paths = materialise(scored.groupBy("__host", "__path").agg(F.count("*").alias("n"), *(F.sum(f"p_{c}").alias(f"s_{c}") for c in CLASSES)), "site-paths")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{c}").alias(f"h_{c}") for c in CLASSES))
    total = hosts.agg(F.sum("hn").alias("n"), F.count("*").alias("k"), *(F.sum(f"h_{c}").alias(c) for c in CLASSES)).first()
    n = total["n"] or 0
    rates = {c: (total[c] / n if n else 0.0) for c in CLASSES}
    joined = paths.join(hosts.withColumnRenamed("__host", "__h"), F.col("__host") == F.col("__h")).drop("__h")
    # method of moments: variance between sites beyond what binomial noise explains, by n-weighted sums
    spread = hosts.agg(*(F.sum(F.col("hn") * F.pow(F.col(f"h_{c}") / F.col("hn") - F.lit(rates[c]), 2)).alias(c) for c in CLASSES)).first()
    inner = joined.agg(F.count("*").alias("k"), *(F.sum(F.col("n") * F.pow(F.col(f"s_{c}") / F.col("n") - F.col(f"h_{c}") / F.col("hn"), 2)).alias(c) for c in CLASSES)).first()

    def strength(c: str, squares: float | None, groups: int) -> float:
        noise = rates[c] * (1 - rates[c])
        between = max(1e-6, ((squares or 0.0) - noise * max(0, groups - 1)) / max(1, n))
        return min(1e5, max(1.0, noise / between))

    return joined, {c: (rates[c], strength(c, spread[c], total["k"] or 0), strength(c, inner[c], inner["k"] or 0)) for c in CLASSES}


def site_rate(c: str, rate: float, k_host: float, k_path: float):
    """A document's site rate of a class, its own probability alone_<class> left out of the sums: path shrunk to host, host to all."""
    own = F.col(f"alone_{c}")
    host = (F.col(f"h_{c}") - own + F.lit(k_host * rate)) / (F.col("hn") - 1 + F.lit(k_host))
    return (F.col(f"s_{c}") - own + F.lit(k_path) * host) / (F.col("n") - 1 + F.lit(k_path))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, host, path, evidence_<class>, site_<class>, p_<class> for low_quality and toxic, kept.

    site_<class> is the rate of the document's site without the document itself, whose evidence counts once. kept: both probabilities are below the threshold. A null text is empty and judged by its surface
    (no words) and site; null hosts and paths are sites named by an empty string; null and repeated ids
    keep their rows. Without labels the evidence is 0 and everything is kept.
    """
    spark = docs.sparkSession
    weights, rates = fit(docs, labels, id_col, text_col, max_labelled)
    model = spark.sparkContext.broadcast(weights)  # at most MAX_FEATURES entries
    prior = [logit(p) for p in rates]
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        w = model.value
        known, start = w.keys(), w.get("\t", (0.0, 0.0))
        release_memo()
        for b in batches:
            low, toxic = [], []
            for text in b.column(3).to_pylist():
                found = [w[f] for f in known & features(text)]
                low.append(start[0] + math.fsum(x[0] for x in found))
                toxic.append(start[1] + math.fsum(x[1] for x in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(low, pa.float64()), pa.array(toxic, pa.float64())], [id_col, "__host", "__path", "evidence_low_quality", "evidence_toxic"])

    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), site(host_col).alias("__host"), site(path_col).alias("__path"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    scored = rows.mapInArrow(score, f"`{id_col}` {id_type}, __host string, __path string, evidence_low_quality double, evidence_toxic double")
    scored = materialise(scored, "evidence")
    sigmoid = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    alone = scored
    for c, p in zip(CLASSES, prior):
        alone = alone.withColumn(f"p_{c}", sigmoid(F.col(f"evidence_{c}") + F.lit(p)))
    sites, shrinkage = site_posteriors(alone)
    out = alone.withColumnsRenamed({f"p_{c}": f"alone_{c}" for c in CLASSES}).join(sites, ["__host", "__path"])
    for c in CLASSES:
        out = out.withColumn(f"site_{c}", site_rate(c, *shrinkage[c]))
        p = F.least(F.greatest(F.col(f"site_{c}"), F.lit(1e-6)), F.lit(1 - 1e-6))
        out = out.withColumn(f"p_{c}", sigmoid(F.col(f"evidence_{c}") + F.log(p / (1 - p))))
    kept = (F.col("p_low_quality") < threshold) & (F.col("p_toxic") < threshold)
    return out.select(id_col, F.col("__host").alias("host"), F.col("__path").alias("path"), *(f"{k}_{c}" for k in ("evidence", "site", "p") for c in CLASSES), kept.alias("kept"))
