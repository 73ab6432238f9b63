"""From mapped spreadsheet rows to ledger rows: cleaning, dimensions, ledger of files. Set-oriented: one DataFrame for each header signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicledger.functions import exprs as X
from civicledger.operators.headers import LEGACY, Mapping

FIELDS = ("supplier", "amount", "date", "service", "directorate", "category", "description")


def apply_legacy(df: DataFrame) -> DataFrame:
    """df with the older map's fields: of several headers of one field the first in column order whose cell is neither empty nor the number 0."""
    cells: dict[str, list] = {}
    for f in df.schema.fields:
        name = LEGACY.get(f.name.lower().strip())
        if name:
            c = F.col(f"`{f.name}`")
            number = f.dataType.typeName() not in ("string",)
            cells.setdefault(name, []).append(F.nullif(c, F.lit(0)).cast("string") if number else F.nullif(c, F.lit("")))
    return df.select("*", *(F.coalesce(*cells[n], F.lit("")).alias(f"legacy_{n}") for n in cells))


def apply_mapping(df: DataFrame, mapping: Mapping) -> DataFrame:
    """The ledger's fields as strings, '' for fields without a header, and __file."""
    by_field = {f: h for h, f in mapping.fields.items()}
    cols = [(F.coalesce(F.col(f"`{by_field[f]}`"), F.lit("")) if f in by_field else F.lit("")).alias(f) for f in FIELDS]
    return df.select(*cols, "__file")


def clean_rows(rows: DataFrame, *keep: str, serial: str | None = None) -> DataFrame:
    """Typed rows with a skip reason (null: none): zero_amount, or totals_line without supplier, any date text and description.

    serial: a column with the date cell's number where a workbook has one. keep: columns that stay.
    """
    number = F.col(serial) if serial else F.lit(None).cast("double")
    trimmed = rows.select(*(X.full_trim(F.col(f)).alias(f) if f not in ("amount", "date") else F.col(f) for f in FIELDS), number.alias("__serial"), "__file", *keep)
    out = trimmed.withColumn("value", X.parse_amount(F.col("amount"))).withColumn("day", F.coalesce(X.serial_date(F.col("__serial")), X.parse_date(F.col("date"))))
    skip = F.when(F.col("value") == 0, "zero_amount").when((F.col("supplier") == "") & (X.full_trim(F.col("date")) == "") & (F.col("description") == ""), "totals_line")
    month = F.when(F.col("day") != "", F.substring("day", 1, 7)).otherwise(X.month_of_filename(F.col("__file")))
    out = out.withColumn("skip", skip).withColumn("month", month).withColumn("fy", F.nullif(X.fy_of_month(F.col("month")), F.lit("")))
    supplier = F.when(F.col("supplier") == "", "Redacted").otherwise(F.col("supplier"))
    return out.select(supplier.alias("supplier"), X.normalise_name(supplier).alias("supplier_key"), F.col("value").cast("decimal(18,2)").alias("amount"), F.col("day").alias("date"), "month", "fy", "service", "directorate", "category", "description", X.document_type(F.col("__file")).alias("document_type"), "skip", F.col("__file").alias("file"), *keep)


def supplier_dimension(rows: DataFrame, *order: str, existing: DataFrame | None = None) -> DataFrame:
    """(id, council_id, name, normalised_name) of suppliers not in `existing`; the first spelling in the order names them.

    The id is a hash of the natural key, so loading twice gives the same ids and needs no global sort.
    """
    first = F.min(F.struct(*order, "name")) if order else F.min(F.struct("name"))
    out = rows.withColumn("normalised_name", X.normalise_name(F.col("name"))).groupBy("council_id", "normalised_name").agg(first["name"].alias("name"))
    if existing is not None:
        out = out.join(existing.select("council_id", "normalised_name"), ["council_id", "normalised_name"], "left_anti")
    return out.select(F.xxhash64("council_id", "normalised_name").alias("id"), "council_id", "name", "normalised_name")


def financial_years(labels: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, council_id, label, start_date, end_date) of labels (council_id, fy) that aren't among the existing; nulls are none."""
    new = labels.select("council_id", F.col("fy").alias("label")).dropna().distinct().join(existing.select("council_id", "label"), ["council_id", "label"], "left_anti")
    first, last = X.fy_bounds(F.col("label"))
    return new.select(F.xxhash64("council_id", "label").alias("id"), "council_id", "label", first.alias("start_date"), last.alias("end_date"))


def new_files(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that their council's ledger doesn't have yet."""
    return found.join(ledger.select("council_id", "url"), ["council_id", "url"], "left_anti")


#: Directorates that head the lines of a budget book, tried in this order.
ANCHORS = (
    "Adults and Health", "Children and Families", "Place", "Homes and Neighbourhoods", "Growth and Regeneration", "Public Health and Corporate Resources",
    "Corporate Strategy, Commissioning and Public Health", "Chief Executive", "Central Budgets", "Corporate",
)


def _book(lines: DataFrame, number: str) -> DataFrame:
    """lines (file, line_no, line) with the directorate last seen, all numbers, and the text before the first."""
    text = X.full_trim(F.col("line"))
    out = lines.select("file", "line_no", text.alias("line")).filter("line <> ''")
    here = F.coalesce(*(F.when(F.lower("line").contains(a.lower()), F.lit(a)) for a in ANCHORS))
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("directorate", F.last(here, ignorenulls=True).over(so_far)).withColumn("found", F.regexp_extract_all("line", F.lit(number), 0))
    clean = F.transform("found", lambda x: F.regexp_replace(x, r"[£,\s()]", "").try_cast("double"))
    before = F.substring(F.col("line"), F.lit(1), F.regexp_instr("line", F.lit(number)) - 1)
    return out.withColumn("amounts", clean).withColumn("service", X.full_trim(before)).withColumn("started", F.max(F.lower("line").rlike("outturn|actual|expenditure and income")).over(so_far))


def budget_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, directorate, service, net_budget, gross_budget) in pounds of a budget book in thousands."""
    b = _book(lines, r"[\d,]+\.?\d*").filter(F.col("directorate").isNotNull() & (F.size("amounts") >= 1) & F.char_length("service").between(3, 79))
    net = F.get("amounts", F.size("amounts") - 1)
    gross = F.when((F.size("amounts") > 1) & (F.coalesce(F.get("amounts", F.lit(0)), F.lit(0.0)) != 0), F.get("amounts", F.lit(0)))
    return b.filter(F.coalesce(net, F.lit(0.0)) != 0).select("file", "line_no", "directorate", "service", (net * 1000).alias("net_budget"), (gross * 1000).alias("gross_budget"))


def outturn_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, directorate, service, net_outturn, variance) after the first line that speaks of outturn."""
    b = _book(lines, r"-?[\d,]+\.?\d*").withColumn("amounts", F.filter("amounts", lambda x: x.isNotNull()))
    b = b.filter(F.col("started") & F.col("directorate").isNotNull() & (F.size("amounts") >= 2) & F.char_length("service").between(3, 79))
    return b.select("file", "line_no", "directorate", "service", (F.get("amounts", F.lit(0)) * 1000).alias("net_outturn"), (F.get("amounts", F.size("amounts") - 1) * 1000).alias("variance"))


def upsert_registry(known: DataFrame, offered: DataFrame, always_active: str | None = None) -> DataFrame:
    """known (slug, name, url, data_gov_id, status) with what offered (slug, name, url, data_gov_id) adds: missing urls and ids, and new rows."""
    o = offered.select("slug", *(F.col(c).alias(f"new_{c}") for c in ("name", "url", "data_gov_id")))
    out = known.join(o, "slug", "full")
    status = F.coalesce("status", F.lit("pending"))
    if always_active:
        status = F.when(F.col("slug") == always_active, "active").otherwise(status)
    return out.select("slug", *(F.coalesce(c, f"new_{c}").alias(c) for c in ("name", "url", "data_gov_id")), status.alias("status"))


def next_status(stats: DataFrame, *keep: str) -> DataFrame:
    """stats with inserted and errors: failing if there were errors and nothing came in, else active."""
    return stats.select(*(keep or ("slug",)), F.when((F.col("errors") > 0) & (F.col("inserted") == 0), "failing").otherwise("active").alias("status"))
