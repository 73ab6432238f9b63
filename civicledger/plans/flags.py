"""Transparency flags: each rule for every council and year at once, from one pass over the transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicledger.functions import exprs as X
from civicledger.plans.queries import Tables
from civicledger.sources.catalog import tiebreak
from civicledger.sources.scratch import materialise

LARGE = 1_000_000
LARGE_ROWS = 50
KEY = ("council_id", "fy")


def sums(t: Tables) -> DataFrame:
    """What the rules need, from one aggregation: a row for each council, year and (kind) supplier, category or large payment.

    Columns: council_id, fy, kind, supplier_id, category, payment (its date, description, amount and order), total, n.
    A transaction counts for its supplier and its category and, if it is large, by itself; partial sums leave few rows to shuffle.
    """
    tx = t["transactions"]
    payment = F.struct(F.col("amount"), F.col("date"), F.col("description"), *tiebreak(tx))
    part = lambda kind, supplier, category, own: F.struct(F.lit(kind).alias("kind"), supplier.alias("supplier_id"), category.alias("category"), own.alias("payment"))
    no_id, no_text, no_payment = (F.when(F.lit(False), c) for c in (F.col("supplier_id"), F.col("category"), payment))
    each = F.array(part("supplier", F.col("supplier_id"), no_text, no_payment), part("category", no_id, F.col("category"), no_payment))
    own = F.array(part("large", F.col("supplier_id"), no_text, F.when(F.lit(True), payment)))
    rows = tx.select(*KEY, "amount", F.explode(F.when(F.col("amount") >= LARGE, F.concat(each, own)).otherwise(each)).alias("r"))
    return rows.groupBy(*KEY, "r").agg(F.sum("amount").alias("total"), F.count("*").alias("n")).select(*KEY, "r.*", "total", "n")


def _named(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    return rows.join(suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name")), "supplier_id", "left")


def _flag(df: DataFrame, order: int, kind: str, severity: Column, title: Column, detail: Column) -> DataFrame:
    return df.select(*KEY, F.lit(order).alias("ord"), F.lit(kind).alias("type"), severity.alias("severity"), title.alias("title"), detail.alias("detail"))


def _part(rows: DataFrame, where: Column) -> DataFrame:
    """All that was spent (grand), and what of it and how many rows fulfil a condition."""
    own = F.coalesce(F.sum(F.when(where, F.col("total"))), F.lit(0)).cast("double")
    return rows.groupBy(*KEY).agg(F.sum("total").cast("double").alias("grand"), own.alias("own"), F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).alias("n_own"))


def _percent() -> Column:
    return F.when(F.col("grand") > 0, F.col("own") / F.when(F.col("grand") > 0, F.col("grand")) * 100)


def _whole(c: Column) -> Column:
    return F.coalesce(X.to_fixed(c, 0), F.lit("0"))


def redacted_spend(s: DataFrame, suppliers: DataFrame) -> DataFrame:
    rows = _part(_named(s.filter("kind = 'supplier'"), suppliers), X.redacted_strict(F.col("supplier_name"))).filter("own > 0")
    detail = F.concat(F.format_string("%,d", "n_own"), F.lit(" payments ("), _whole(_percent()), F.lit("% of total spend) to undisclosed vendors"))
    return _flag(rows, 1, "redacted_spend", X.severity(_percent(), 30, 15), F.concat(X.short_amount(F.col("own")), F.lit(" to redacted suppliers")), detail)


def missing_category(s: DataFrame, suppliers: DataFrame) -> DataFrame:
    rows = _part(s.filter("kind = 'category'"), F.col("category").isNull() | F.col("category").isin("", "REDACTED DATA")).filter("n_own > 0")
    detail = F.concat(F.format_string("%,d", "n_own"), F.lit(" transactions ("), _whole(_percent()), F.lit("% of spend) have blank or redacted category data"))
    return _flag(rows, 2, "missing_data", X.severity(_percent(), 30, 15), F.concat(X.short_amount(F.col("own")), F.lit(" with no category")), detail)


def _large(s: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The largest payments of at least LARGE, cut before anything else is asked of them; payments that are alike in all were summed up, and come apart as often as the cut can use."""
    rows = s.filter("kind = 'large'").select(*KEY, "supplier_id", "payment.*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(LARGE_ROWS).cast("long")))).alias("copy"))
    order = [c for c in rows.columns if c not in (*KEY, "supplier_id", "amount", "date", "description")]
    w = Window.partitionBy(*KEY).orderBy(F.desc("amount"), "date", *order)
    return _named(rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= LARGE_ROWS), suppliers)


def large_redacted(s: DataFrame, suppliers: DataFrame) -> DataFrame:
    g = _large(s, suppliers).filter(X.redacted_loose(F.col("supplier_name"))).groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))
    return _flag(g, 3, "large_payment", F.lit("high"), F.concat(F.col("n").cast("string"), F.lit(" large payments to redacted suppliers")), F.concat(X.short_amount(F.col("total")), F.lit(" total across payments over £1m to undisclosed vendors")))


def large_named(s: DataFrame, suppliers: DataFrame, most: int = 3) -> DataFrame:
    """Each supplier's largest payment, for the first few suppliers."""
    rows = _large(s, suppliers).filter(~X.redacted_loose(F.col("supplier_name")) & (F.coalesce("supplier_name", F.lit("")) != "")).withColumn("key", X.normalise_name(F.col("supplier_name")))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*KEY, "key").orderBy("rn"))).filter("k = 1")
    top = first.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("rn"))).filter(F.col("place") <= most)
    title = F.concat(X.short_amount(F.col("amount")), F.lit(" to "), F.col("supplier_name"))
    detail = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("date"), F.lit("")), F.lit(""))
    return _flag(top, 4, "large_payment", F.when(F.col("amount") >= 5 * LARGE, "high").otherwise("medium"), title, detail)


def concentration(s: DataFrame, suppliers: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy(*KEY)
    g = s.filter("kind = 'supplier'").withColumn("grand", F.sum("total").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("total"), F.col("supplier_id").asc_nulls_first())))
    g = g.filter((F.col("place") <= most) & (F.col("grand") > 0)).groupBy(*KEY).agg(F.sum("total").cast("double").alias("top"), F.first("grand").cast("double").alias("grand"))
    g = g.withColumn("p", F.col("top") / F.when(F.col("grand") > 0, F.col("grand")) * 100).filter("p > 25")
    high = F.col("p") > 40
    return _flag(g, 5, "supplier_concentration", F.when(high, "high").otherwise("medium"), F.concat(F.when(high, "High").otherwise("Moderate"), F.lit(" supplier concentration")), F.concat(F.lit("Top 5 suppliers account for "), X.to_fixed(F.col("p"), 1), F.lit("% of total spend")))


def rising_category(s: DataFrame, suppliers: DataFrame, most: int = 3) -> DataFrame:
    """Categories that grew by over 30 percent and 100,000 from over 200,000. Among the previous year's groups of one label the smallest counts."""
    g = s.filter("kind = 'category'").select(*KEY, F.col("category").alias("raw"), X.blank_label(F.col("category"), "No Category").alias("label"), F.col("total").cast("double").alias("total"))
    before = g.groupBy("council_id", F.col("fy").alias("previous"), "label").agg(F.min("total").alias("was"))
    now = g.withColumn("previous", X.previous_fy(F.col("fy"))).join(before, ["council_id", "previous", "label"])
    up = F.col("total") - F.col("was")
    now = now.filter((F.col("was") > 200_000) & (F.col("total") > 200_000)).withColumn("up", up).withColumn("p", up / F.when(F.col("was") > 0, F.col("was")) * 100).filter("p > 30 AND up > 100000")
    top = now.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("up"), "label", F.col("raw").asc_nulls_first()))).filter(F.col("place") <= most)
    return _flag(top, 6, "rising_category", F.when(F.col("p") > 100, "high").otherwise("medium"), F.concat(F.lit("Rising: "), F.col("label")), F.concat(F.lit("Up "), X.to_fixed(F.col("p"), 0), F.lit("% ("), X.short_amount(F.col("up")), F.lit(") year-on-year")))


RULES = (redacted_spend, missing_category, large_redacted, large_named, concentration, rising_category)


def all_flags(t: Tables, council_id: int | None = None, fy: str | None = None) -> DataFrame:
    """All rules in their order; at most ten rows for a council and year. The sums are computed once and written, and every rule reads them."""
    if council_id is not None:
        t = t | {"transactions": t["transactions"].filter(F.col("council_id") == council_id)}
    s = materialise(sums(t), "flag-sums")
    out = reduce(DataFrame.unionByName, (rule(s, t["suppliers"]) for rule in RULES))
    return (out.filter(F.col("fy") == fy) if fy else out).orderBy("council_id", "fy", "ord")
