"""Ingestion end to end: landed files of any header signature into the stored ledger, with a council's run statistics.

A file is parsed in one task, where its header row is mapped and its supplier column checked; from
there on rows of all files are one DataFrame. Files that are empty or lack a required column give no
rows and no ledger row, so they are tried again next time; why a file failed is kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.functions import exprs as X
from civicledger.operators.headers import URL_SAMPLE, detect, swap_url_supplier
from civicledger.operators.ingest import FIELDS, clean_rows, financial_years, new_files, next_status, supplier_dimension
from civicledger.operators.warehouse import Change, Ledger
from civicledger.sources.scratch import materialise
from civicledger.sources.spreadsheets import rows_of

PARSED = "council_id long, url string, filename string, file_row long, " + ", ".join(f"{f} string" for f in FIELDS) + ", serial double, n_rows long, mapping string, missing string, error string"

#: Types of the documents that hold transactions.
SPENDING_TYPES = ("expenditure", "procurement_card")


def councils_to_process(councils: DataFrame, slug: str | None = None, status: str = "active") -> DataFrame:
    """The council of a slug, else all of a status."""
    return councils.filter(F.col("slug") == slug) if slug else councils.filter(F.col("status") == status)


def parse_files(files: DataFrame) -> DataFrame:
    """files (council_id, url, filename, content, profile) as rows of PARSED: one for each file (file_row 0), one for each data row.

    profile: a JSON object header -> field that overrides detection, or null; one that isn't such an object is ignored.
    serial: the date cell's number where it is one.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        for b in batches:
            for council, url, name, content, profile in zip(*(b.column(c).to_pylist() for c in ("council_id", "url", "filename", "content", "profile"))):
                out: list[tuple] = []
                none = ("",) * len(FIELDS)
                try:
                    head, rows = rows_of(name, content)
                    mapping = detect(head, override_of(profile))
                    if rows and not mapping.missing:
                        mapping = swap_url_supplier(mapping, [str(r.get(header_of(mapping, "supplier"), "")) for r in rows[:URL_SAMPLE]], head)
                    out.append((council, url, name, 0, *none, None, len(rows), json.dumps(mapping.fields), ", ".join(mapping.missing), None))
                    if not mapping.missing:
                        at = {f: h for h, f in mapping.fields.items()}
                        for k, row in enumerate(rows, 1):
                            cells = [row.get(at.get(f), "") for f in FIELDS]
                            date = cells[FIELDS.index("date")]
                            out.append((council, url, name, k, *map(_text, cells), date if isinstance(date, float) else None, None, None, None, None))
                except Exception as e:  # a file that can't be read is an error of its council's run, as any reader of archives may raise
                    out = [(council, url, name, 0, *none, None, 0, None, "", f"{type(e).__name__}: {e}")]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * len(FIELDS), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return files.select("council_id", "url", "filename", "content", "profile").mapInArrow(parse, PARSED)


def override_of(profile: str | None) -> dict[str, str] | None:
    try:
        found = json.loads(profile) if profile else None
    except ValueError:
        return None
    return {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else None


def header_of(mapping, field: str) -> str | None:
    return next((h for h, f in mapping.fields.items() if f == field), None)


def _text(cell) -> str:
    """A cell as text; whole numbers without a decimal point."""
    return (str(int(cell)) if cell == int(cell) else repr(cell)) if isinstance(cell, float) else cell


def ingest(ledger: Ledger, landed: DataFrame, now: str, change: Change | None = None, note: str = "ingest", parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Takes in what of landed (council_id, url, filename, content, profile) the ledger doesn't have yet, all of it in one change.

    Returns a row for each council with landed files: council_id, discovered, new, inserted, skipped, errors, status.
    A url that is landed twice for a council counts once. now: the time that the ledger notes. Files that can't be
    taken in go to the table quarantine with the reason. change: one that this run completes; what it has taken away
    isn't there any more. parse: makes rows of PARSED of the files; with `large_files.scan_files` landed has path instead of content.
    """
    change = change or ledger.begin(note)
    landed = landed.dropDuplicates(["council_id", "url"])
    new = new_files(landed, change.table("source_documents"))
    parsed = materialise((parse or parse_files)(new), "parsed-files")
    files = parsed.filter("file_row = 0")
    good = files.filter("n_rows > 0 AND missing = '' AND error IS NULL")
    cleaned = clean_rows(parsed.filter("file_row > 0").withColumn("__file", F.col("filename")), "council_id", "url", "file_row", "mapping", serial="serial")
    cleaned = materialise(cleaned, "cleaned-rows")
    rows = cleaned.filter("skip IS NULL")
    batch = uuid.uuid4().hex
    # dimensions: what isn't there yet
    names = rows.select("council_id", F.col("supplier").alias("name"), "file", "file_row")
    change.add("suppliers", supplier_dimension(names, "file", "file_row", existing=change.table("suppliers")))
    of_file = X.fy_of_month(X.month_of_filename(F.col("filename")))
    documents = good.select(
        "council_id", F.nullif(of_file, F.lit("")).alias("fy"), "filename", "url", X.document_type(F.col("filename")).alias("type"),
        F.lit(now).alias("downloaded_at"), F.col("mapping").alias("column_mapping"), F.lit(batch).alias("batch"), F.xxhash64("council_id", "url").alias("id"))
    labels = rows.select("council_id", "fy").union(documents.select("council_id", "fy"))
    change.add("financial_years", financial_years(labels, change.table("financial_years")))
    change.add("transactions", rows.select(
        F.xxhash64("council_id", "supplier_key").alias("supplier_id"), "service", "directorate", "category", "description", "amount", "date", "month",
        F.xxhash64("council_id", "url").alias("source_document_id"), "file_row", F.lit(batch).alias("batch"), "council_id", "fy"), clustered=True)
    change.add("source_documents", documents)
    change.add("quarantine", failures(files).withColumn("noted_at", F.lit(now)).withColumn("batch", F.lit(batch)))
    change.commit()
    return run_statistics(landed, files, cleaned)


def reload_council(ledger: Ledger, council_id: int, landed: DataFrame, now: str) -> DataFrame:
    """Takes a council's files in anew: its transactions and their documents go and what landed has of it comes, in one change; other councils stay untouched.

    Documents of other kinds (budget books) stay. Suppliers and years stay too: their ids are those of their keys.
    Until the change is committed, and if it never is, the ledger is as before.
    """
    change = ledger.begin("reload")
    kept = change.table("source_documents").filter((F.col("council_id") == council_id) & ~F.coalesce(F.col("type").isin(*SPENDING_TYPES), F.lit(False)))
    kept = materialise(kept, "kept-documents")
    change.drop("transactions", council_id)
    change.drop("source_documents", council_id)
    change.add("source_documents", kept)
    return ingest(ledger, landed.filter(F.col("council_id") == council_id), now, change)


def failures(files: DataFrame) -> DataFrame:
    """(council_id, url, filename, n_rows, error) of the parsed files that can't be taken in; an empty file isn't among them."""
    lacks = (F.col("missing") != "") & (F.col("n_rows") > 0)
    failed = files.filter(F.col("error").isNotNull() | lacks)
    return failed.select("council_id", "url", "filename", "n_rows", F.coalesce("error", F.concat(F.lit("missing columns "), "missing")).alias("error"))


def open_failures(ledger: Ledger) -> DataFrame:
    """(council_id, url, filename, n_rows, error, times): files that have failed and never came in since, by their last failure."""
    t = ledger.tables()
    last = F.max_by(F.struct("filename", "n_rows", "error"), F.struct("noted_at", "batch", "error"))
    found = t["quarantine"].groupBy("council_id", "url").agg(last.alias("last"), F.count("*").alias("times"))
    found = found.join(t["source_documents"].select("council_id", "url"), ["council_id", "url"], "left_anti")
    return found.select("council_id", "url", "last.filename", "last.n_rows", "last.error", "times")


def run_statistics(landed: DataFrame, files: DataFrame, cleaned: DataFrame) -> DataFrame:
    """What a run did for each council, and the council's next status."""
    found = landed.groupBy("council_id").agg(F.count("*").alias("discovered"))
    failed = (F.col("missing") != "") & (F.col("n_rows") > 0) | F.col("error").isNotNull()
    tried = files.groupBy("council_id").agg(F.count("*").alias("new"), F.count_if(failed).alias("errors"), F.sum(F.when((F.col("missing") != "") & F.col("error").isNull(), F.col("n_rows")).otherwise(0)).alias("passed_over"))
    done = cleaned.groupBy("council_id").agg(F.count_if(F.col("skip").isNull()).alias("inserted"), F.count_if(F.col("skip").isNotNull()).alias("skipped_rows"))
    out = found.join(tried, "council_id", "left").join(done, "council_id", "left").na.fill(0)
    out = out.select("council_id", "discovered", "new", "inserted", (F.col("skipped_rows") + F.col("passed_over")).alias("skipped"), "errors")
    return next_status(out, "council_id", "discovered", "new", "inserted", "skipped", "errors")


def run_totals(statistics: DataFrame) -> DataFrame:
    """inserted and errors of a whole run."""
    return statistics.agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))


def note_run(ledger: Ledger, statistics: DataFrame, now: str) -> None:
    """The councils' new status and the time of the run in the registry."""
    stats = statistics.select(F.col("council_id").alias("id"), F.col("status").alias("now_status"))
    with ledger.begin("registry") as change:
        councils = change.table("councils").join(stats, "id", "left")
        seen = F.col("now_status").isNotNull()
        councils = councils.withColumn("status", F.coalesce("now_status", "status")).withColumn("last_scraped_at", F.when(seen, F.lit(now)).otherwise(F.col("last_scraped_at"))).drop("now_status")
        change.replace("councils", councils)
