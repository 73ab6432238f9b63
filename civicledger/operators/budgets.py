"""Budget books and statements of accounts into the ledger: texts of files as lines, the year from the file's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicledger.operators.ingest import budget_lines, financial_years, new_files, outturn_lines
from civicledger.operators.warehouse import Ledger
from civicledger.sources.scratch import materialise


def year_of_name(name: Column) -> Column:
    """The first yyyy-yy of a file's name, null without one."""
    return F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2})", 1), F.lit(""))


def book_kind(name: Column) -> Column:
    """budget or accounts by a PDF's name; null for other files."""
    accounts = name.contains("statement-of-accounts")
    budget = name.contains("budget") | name.contains("summary")
    return F.when(name.endswith(".pdf"), F.when(budget, "budget").when(accounts, "accounts"))


def budget_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(budgets, outturns) with council_id and fy from lines (council_id, file, line_no, line); files without a year give none."""
    lines = lines.withColumn("file", F.struct("council_id", "file"))
    name, own = F.col("file.file"), (F.col("file.council_id").alias("council_id"), year_of_name(F.col("file.file")).alias("fy"))
    use = lambda kind: lines.filter((book_kind(name) == kind) & year_of_name(name).isNotNull())
    budgets = budget_lines(use("budget")).select(*own, "directorate", "service", "net_budget", "gross_budget")
    outturns = outturn_lines(use("accounts")).select(*own, "directorate", "service", "net_outturn", "variance")
    return budgets, outturns


def load_budgets(ledger: Ledger, lines: DataFrame, base_url: str, now: str) -> None:
    """Replaces the budgets and outturns of the councils and years that lines have, and keeps the others.

    Each file gets one row among the source documents, however often it is loaded.
    """
    budgets, outturns = (materialise(df, "book-lines") for df in budget_tables(lines))
    with ledger.begin("budgets") as change:
        for name, rows in (("budgets", budgets), ("outturns", outturns)):
            years = rows.select("council_id", "fy").distinct()
            kept = change.table(name).join(years, ["council_id", "fy"], "left_anti")
            change.replace(name, kept.unionByName(rows, allowMissingColumns=True))
        files = lines.select("council_id", F.col("file").alias("filename")).distinct()
        files = files.select("council_id", year_of_name(F.col("filename")).alias("fy"), "filename", F.concat(F.lit(base_url), "filename").alias("url"), book_kind(F.col("filename")).alias("type"))
        files = files.filter("fy IS NOT NULL AND type IS NOT NULL")
        new = new_files(files, change.table("source_documents"))
        change.add("source_documents", new.withColumn("id", F.xxhash64("council_id", "url")).withColumn("downloaded_at", F.lit(now)))
        change.add("financial_years", financial_years(files.select("council_id", "fy"), change.table("financial_years")))
