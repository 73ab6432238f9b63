"""Questions asked of the ledger. Each takes the catalog's tables and returns a DataFrame for all councils, or for one.

Money is summed as decimal, so sums don't depend on the order of rows, and shown as double.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicledger.functions import exprs as X
from civicledger.plans.paging import MOST, deep_page, sort_columns
from civicledger.sources.catalog import tiebreak

Tables = dict[str, DataFrame]


def _money(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def _slice(df: DataFrame, council_id: int | None, fy: str | None = None) -> DataFrame:
    """One council, one year, or all where None; a year that nobody has is no filter to the callers, who resolve it first."""
    if council_id is not None:
        df = df.filter(F.col("council_id") == council_id)
    return df.filter(F.col("fy") == fy) if fy else df


# --- lookups


def council_by_slug(t: Tables, slug: str) -> DataFrame:
    return t["councils"].filter(F.col("slug") == slug).limit(1)


def financial_years(t: Tables, council_id: int | None = None) -> DataFrame:
    return _slice(t["transactions"], council_id).select("council_id", F.col("fy").alias("label")).distinct().orderBy("council_id", F.desc("label"))


def latest_financial_year(t: Tables, council_id: int | None = None) -> DataFrame:
    return _slice(t["transactions"], council_id).groupBy("council_id").agg(F.max("fy").alias("label"))


def distinct_values(t: Tables, column: str, council_id: int | None = None) -> DataFrame:
    """Values of a text column but null and empty ones; white space stays."""
    return _slice(t["transactions"], council_id).filter(F.col(column).isNotNull() & (F.col(column) != "")).select("council_id", column).distinct().orderBy("council_id", column)


def council_list(t: Tables) -> DataFrame:
    """Every council with its number of transactions, 0 for none."""
    counts = t["transactions"].groupBy("council_id").agg(F.count("*").alias("n"))
    out = t["councils"].join(counts, F.col("id") == F.col("council_id"), "left")
    return out.select("id", "name", "slug", "region", "status", F.coalesce("n", F.lit(0)).alias("transaction_count")).orderBy("name")


def council_regions(t: Tables) -> DataFrame:
    """Regions of active councils and how many they have; councils without one are in Other."""
    return t["councils"].filter("status = 'active'").groupBy(F.coalesce("region", F.lit("Other")).alias("region")).agg(F.count("*").alias("councils")).orderBy("region")


def council_search(t: Tables, query: str) -> DataFrame:
    q = query.lower()
    hit = F.lower("name").contains(q) | F.lower("region").contains(q)
    return t["councils"].filter((F.col("status") == "active") & hit).select("id", "name", "slug", "region")


def registry_status_counts(t: Tables) -> DataFrame:
    return t["councils"].groupBy("status").agg(F.count("*").alias("councils"))


def council_sections(t: Tables, statuses: tuple[str, ...] = ("active", "pending", "failing")) -> DataFrame:
    """The list of councils by section, in the sections' order and by name; councils of any other status are shown nowhere."""
    place = F.array_position(F.array(*map(F.lit, statuses)), F.col("status"))
    return t["councils"].filter(place > 0).orderBy(place, "name").select("id", "name", "slug", "region", F.col("status").alias("section"))


def health(t: Tables) -> DataFrame:
    return t["councils"].agg(F.count("*").alias("councils"))


# --- overview


def overview_spend(t: Tables, council_id: int | None = None, fy: str | None = None) -> DataFrame:
    return _slice(t["transactions"], council_id, fy).groupBy("council_id", "fy").agg(_money("amount").alias("total"), F.count("*").alias("transactions"), F.countDistinct("supplier_id").alias("suppliers"))


def overview_budget(t: Tables, council_id: int | None = None, fy: str | None = None) -> DataFrame:
    return _slice(t["budgets"], council_id, fy).groupBy("council_id", "fy").agg(_money("net_budget").alias("net"), _money("gross_budget").alias("gross"))


def overview_outturn(t: Tables, council_id: int | None = None, fy: str | None = None) -> DataFrame:
    return _slice(t["outturns"], council_id, fy).groupBy("council_id", "fy").agg(_money("net_outturn").alias("net"), _money("variance").alias("variance"))


def budget_of_all(t: Tables) -> DataFrame:
    """Without a year, budgets of all councils are summed."""
    return t["budgets"].agg(_money("net_budget").alias("net"), _money("gross_budget").alias("gross"))


def _yearly(t: Tables, *more: str) -> DataFrame:
    return t["transactions"].groupBy("council_id", "fy", *more).agg(F.sum("amount").alias("total"))


def overview_yoy(t: Tables) -> DataFrame:
    """Change on the year before in percent; null without such a year or if its sum isn't positive."""
    return _change(_yearly(t)).select("council_id", "fy", "total", "previous_total", "yoy_change")


def _change(years: DataFrame) -> DataFrame:
    """years (council_id, fy, total) with what there was the year before; the years are few rows, so joining them by themselves is cheap."""
    before = years.select("council_id", F.col("fy").alias("previous"), F.col("total").cast("double").alias("previous_total"))
    now = years.withColumn("total", F.col("total").cast("double")).withColumn("previous", X.previous_fy(F.col("fy")))
    prev = F.col("previous_total")
    change = F.when(prev > 0, F.round((F.col("total") - prev) / F.when(prev > 0, prev) * 100, 4))
    return now.join(before, ["council_id", "previous"], "left").withColumn("yoy_change", change)


def overview_average(t: Tables) -> DataFrame:
    """Average transaction; 0 without any."""
    s = overview_spend(t)
    return s.select("council_id", "fy", F.when(F.col("transactions") > 0, F.round(F.col("total") / F.col("transactions"), 4)).otherwise(F.lit(0.0)).alias("average"))


def overview_cards(t: Tables) -> DataFrame:
    """Which figures a council's page shows: budget or average; over- or underspend, else change on the year, else nothing."""
    key = ["council_id", "fy"]
    b = overview_budget(t).select(*key, F.col("net").alias("net_budget"), F.col("gross").alias("gross_budget"))
    o = overview_outturn(t).select(*key, F.col("net").alias("net_outturn"), "variance")
    out = _change(_yearly(t)).join(b, key, "left").join(o, key, "left")
    has_budget = (F.coalesce("net_budget", F.lit(0.0)) != 0) | (F.coalesce("gross_budget", F.lit(0.0)) != 0)
    has_outturn = (F.coalesce("net_outturn", F.lit(0.0)) != 0) & (F.coalesce("variance", F.lit(0.0)) != 0)
    second = F.when(has_outturn & (F.col("variance") > 0), "overspend").when(has_outturn, "underspend").when(F.col("yoy_change").isNotNull(), "yoy").otherwise("none")
    return out.select(*key, F.when(has_budget, "budget").otherwise("average").alias("first_card"), second.alias("second_card"))


# --- listing


@dataclass(frozen=True)
class Filters:
    """Optional terms, all of which must hold; None, empty text and 0 are no term. `supplier` counts only if strict."""

    fy: str | None = None
    directorate: str | None = None
    category: str | None = None
    supplier: int | None = None
    search: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    start_date: str | None = None
    end_date: str | None = None
    strict: bool = False

    def predicate(self, council_id: int) -> Column:
        c = F.col
        terms = [c("council_id") == council_id]
        terms += [c(n) == getattr(self, n) for n in ("fy", "directorate", "category") if getattr(self, n)]
        if self.min_amount:
            terms.append(c("amount") >= self.min_amount)
        if self.max_amount:
            terms.append(c("amount") <= self.max_amount)
        if self.start_date:
            terms.append(c("date") >= self.start_date)
        if self.end_date:
            terms.append(c("date") <= self.end_date)
        if self.search:
            terms.append(X.like_ascii(c("description"), self.search) | X.like_ascii(c("service"), self.search))
        if self.strict and self.supplier:
            terms.append(c("supplier_id") == self.supplier)
        return reduce(and_, terms)


SORTS = {"amount": "amount", "date": "date", "supplier": "supplier_id", "directorate": "directorate"}


def transactions_page(t: Tables, council_id: int, filters: Filters = Filters(), page: int = 1, page_size: int = 50, sort_by: str = "amount", sort_dir: str = "desc", deep: int = MOST) -> DataFrame:
    """One page of the filtered transactions. The rows are chosen first and get their names afterwards.

    A page that ends within the first `deep` rows is cut from their order; what stands before any other is counted, not gathered.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start from 1")
    by = [(SORTS.get(sort_by, "amount"), sort_dir == "asc"), *((c, True) for c in tiebreak(t["transactions"]))]
    order, offset = sort_columns(by), (page - 1) * page_size
    rows = t["transactions"].filter(filters.predicate(council_id))
    rows = rows.orderBy(*order).offset(offset).limit(page_size) if offset + page_size <= deep else deep_page(rows, by, offset, page_size, deep)
    named = rows.join(t["suppliers"].select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name")), "supplier_id", "left")
    named = named.join(t["source_documents"].select(F.col("id").alias("source_document_id"), F.col("filename").alias("source_file")), "source_document_id", "left")
    return named.orderBy(*order).select("supplier_name", F.col("amount").cast("double").alias("amount"), "date", "month", "directorate", "service", "category", "description", "source_file")


def transactions_count(t: Tables, council_id: int, filters: Filters = Filters(), page_size: int = 50) -> DataFrame:
    n = t["transactions"].filter(filters.predicate(council_id)).agg(F.count("*").alias("total"))
    return n.select("total", F.ceil(F.col("total") / page_size).cast("long").alias("total_pages"))


# --- breakdowns


def by_category(t: Tables, council_id: int | None = None, fy: str | None = None) -> DataFrame:
    """Groups are labelled after grouping, so a council may have several named No Category."""
    g = _slice(t["transactions"], council_id, fy).groupBy("council_id", "category").agg(_money("amount").alias("total"), F.count("*").alias("count"))
    return g.select("council_id", X.blank_label(F.col("category"), "No Category").alias("category"), "total", "count").orderBy("council_id", F.desc("total"))


def _top_groups(t: Tables, column: str, council_id, fy, most: int) -> DataFrame:
    g = _slice(t["transactions"], council_id, fy).groupBy("council_id", F.col(column).alias("name")).agg(_money("amount").alias("total"), F.count("*").alias("count"))
    w = Window.partitionBy("council_id").orderBy(F.desc("total"), F.col("name").asc_nulls_first())
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("rank")


def by_service(t: Tables, council_id: int | None = None, fy: str | None = None, most: int = 15) -> DataFrame:
    return _top_groups(t, "service", council_id, fy, most).select("council_id", X.blank_label(F.col("name"), "No Service Area").alias("name"), "total", "count")


def by_directorate(t: Tables, council_id: int | None = None, fy: str | None = None, most: int = 15) -> DataFrame:
    """The top groups, cut before blank ones go; services for councils that have no directorate left. One pass over the transactions groups by both."""
    each = F.array(*(F.struct(F.lit(level).alias("level"), F.col(level).alias("name")) for level in ("directorate", "service")))
    g = _slice(t["transactions"], council_id, fy).select("council_id", "amount", F.explode(each).alias("g")).groupBy("council_id", "g.level", "g.name").agg(_money("amount").alias("total"), F.count("*").alias("count"))
    w = Window.partitionBy("council_id", "level").orderBy(F.desc("total"), F.col("name").asc_nulls_first())
    g = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    shown = (F.col("level") == "service") | (F.coalesce(X.full_trim(F.col("name")), F.lit("")) != "")
    g = g.filter(shown).withColumn("own", F.max(F.col("level") == "directorate").over(Window.partitionBy("council_id"))).filter(F.col("own") == (F.col("level") == "directorate"))
    name = F.when(F.col("level") == "service", X.blank_label(F.col("name"), "No Service Area")).otherwise(F.col("name"))
    return g.select("council_id", name.alias("name"), "total", "count", "level")


def directorate_chart(t: Tables, council_id: int | None = None, fy: str | None = None, most: int = 10) -> DataFrame:
    """The chart's rows: the first of what `by_directorate` gives."""
    w = Window.partitionBy("council_id").orderBy(F.desc("total"), F.col("name").asc_nulls_first())
    return by_directorate(t, council_id, fy).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("council_id", "place", "name", "total")


def top_suppliers(t: Tables, council_id: int | None = None, fy: str | None = None, most: int = 20) -> DataFrame:
    """Sums by supplier first, names and shares after; 0 percent where a council's total isn't positive."""
    g = _slice(t["transactions"], council_id, fy).groupBy("council_id", "supplier_id").agg(F.sum("amount").alias("sum"), F.count("*").alias("count"))
    whole = Window.partitionBy("council_id")
    g = g.withColumn("grand", F.sum("sum").over(whole).cast("double")).withColumn("total", F.col("sum").cast("double"))
    ranked = g.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("sum"), F.col("supplier_id").asc_nulls_first()))).filter(F.col("rank") <= most)
    share = F.when(F.col("grand") > 0, F.round(F.col("total") / F.when(F.col("grand") > 0, F.col("grand")) * 100, 4)).otherwise(F.lit(0.0))
    names = t["suppliers"].select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    return ranked.join(names, "supplier_id", "left").select("council_id", "rank", "supplier_id", "supplier_name", "total", "count", share.alias("percentage"))


def supplier_ranking_bars(t: Tables) -> DataFrame:
    """Width of each supplier's bar, relative to the council's first."""
    first = F.max("total").over(Window.partitionBy("council_id"))
    return top_suppliers(t).select("council_id", "rank", F.coalesce("supplier_name", F.lit("Unknown")).alias("supplier_name"), F.when(first > 0, F.round(F.col("total") / F.when(first > 0, first), 4)).otherwise(F.lit(0.0)).alias("width"))


def monthly_trend(t: Tables, council_id: int | None = None, fy: str | None = None) -> DataFrame:
    g = _slice(t["transactions"], council_id, fy).filter(F.coalesce(X.full_trim(F.col("month")), F.lit("")) != "")
    return g.groupBy("council_id", "month").agg(_money("amount").alias("total"), F.count("*").alias("count")).orderBy("council_id", "month")


def category_top_other(t: Tables, most: int = 8) -> DataFrame:
    """The largest categories and, if positive, the sum of the others."""
    g = t["transactions"].groupBy("council_id", "service").agg(F.sum("amount").alias("sum"))
    w = Window.partitionBy("council_id").orderBy(F.desc("sum"), F.col("service").asc_nulls_first())
    g = g.withColumn("rank", F.least(F.row_number().over(w), F.lit(most + 1))).withColumn("name", F.when(F.col("rank") <= most, F.col("service")).otherwise(F.lit("Other")))
    return g.groupBy("council_id", "rank", "name").agg(_money("sum").alias("total")).filter((F.col("rank") <= most) | (F.col("total") > 0))


def category_share(t: Tables, smallest: float = 0.06) -> DataFrame:
    """Share of each category in its council; shares below the smallest have no label."""
    g = by_category(t)
    whole = F.sum("total").over(Window.partitionBy("council_id"))
    share = F.when(whole > 0, F.round(F.col("total") / F.when(whole > 0, whole), 4))
    return g.select("council_id", "category", share.alias("share"), (share >= smallest).alias("labelled"))
