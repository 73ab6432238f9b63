"""The registered queries of ingestion, discovery and the stored ledger, and their oracle SQL.

Files, pages and answers are texts made from keys of the driver's tables, the same on both sides.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicledger.functions import exprs as X
from civicledger.operators import budgets as B
from civicledger.operators import ingest as I
from civicledger.operators import publish as P
from civicledger.operators import runs as R
from civicledger.operators.large_files import scan_files
from civicledger.operators.warehouse import Ledger
from civicledger.plans import queries as Q
from civicledger.plans import search
from civicledger.registry_of_queries import BASE, ORDER, SPEND_ORACLES
from civicledger.sources import catalog, discovery, seed
from civicledger.sources.scratch import scratch_dir
from civicledger.sources.spreadsheets import list_files

RUN_QUERIES: dict = {}
RUN_ORACLES: dict[str, str] = {}
NOW = "2025-01-01T00:00:00Z"


def _register(name: str, oracle: str | None):
    def add(f):
        RUN_QUERIES[name] = f
        if oracle:
            RUN_ORACLES[name] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ledger(spark: SparkSession) -> Ledger:
    return Ledger.create(spark, f"{scratch_dir(spark)}/ledger-{uuid4().hex}")


# --- ingestion: each nation has published files of up to 500 customers' numbers; every third nation's lack the required columns

HEADERS = ("Supplier,Amount,Date,Directorate,Description", "Vendor Name,Amount Excluding VAT,Payment Date,Cost Centre Description,Purpose of Spend", "Date,Narrative,Other,Notes,More")


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file for each nation with a line for each of its customers, those of keys divisible by 10 without an amount."""
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    amount = F.when(key % 10 == 0, F.lit("0")).otherwise(F.concat(F.lit("£"), key.cast("string"), F.lit(".50")))
    date = F.concat_ws("/", (key % 28 + 1).cast("string"), (key % 12 + 1).cast("string"), (key % 5 + 2000).cast("string"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    line = F.concat_ws(",", quoted(F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.col("c_name"), F.lit(", Ltd")))), quoted(amount), F.when(key % 9 == 0, F.lit("")).otherwise(date), F.col("c_mktsegment"), F.when(key % 11 == 0, F.lit("")).otherwise(F.lit("a \"\"b\"\"").substr(1, 1)))
    files = c.groupBy(F.col("c_nationkey").cast("long").alias("council_id"), F.expr("c_custkey div 500").alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x.line), "\n").alias("body"))
    head = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("council_id") % 3 + 1).cast("int"))
    name = F.when(F.col("council_id") % 2 == 0, F.lit("spend-2024-05.csv")).otherwise(F.lit("Purchase-Card-2023_02_28.csv"))
    return files.select("council_id", F.concat_ws("/", F.lit("https://council"), F.col("council_id").cast("string"), F.col("part").cast("string")).alias("url"), name.alias("filename"), F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n")).cast("binary").alias("content"), F.lit("{not json").alias("profile"))


_FILES = """
with c as (select c_nationkey::bigint as council_id, c_custkey as k, c_custkey // 500 as part, case when c_custkey % 7 = 0 then '' else c_name || ', Ltd' end as supplier,
  case when c_custkey % 10 = 0 then 0 else c_custkey + 0.5 end::double as amount, case when c_custkey % 9 = 0 then '' else (c_custkey % 5 + 2000)::varchar || '-' || lpad((c_custkey % 12 + 1)::varchar, 2, '0') || '-' || lpad((c_custkey % 28 + 1)::varchar, 2, '0') end as date,
  c_mktsegment as place, case when c_custkey % 11 = 0 then '' else 'a' end as description,
  case when c_nationkey % 2 = 0 then 'spend-2024-05.csv' else 'Purchase-Card-2023_02_28.csv' end as file, case when c_nationkey % 2 = 0 then '2024-05' else '2023-02' end as file_month from customer),
r as (select *, case when date = '' then file_month else left(date, 7) end as month, case when amount = 0 or (supplier = '' and date = '' and description = '') then 1 else 0 end as skipped from c),
good as (select *, case when substr(month, 6, 2)::int >= 4 then left(month, 4)::int else left(month, 4)::int - 1 end as y from r where council_id % 3 <> 2 and skipped = 0)
"""


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[Ledger, DataFrame, DataFrame]:
    """A ledger that has been offered the same files twice, and both runs' statistics."""
    ledger = _ledger(spark)
    files = landed_files(spark, sf_dir)
    first = R.ingest(ledger, files, NOW)
    return ledger, first, R.ingest(ledger, files.unionByName(files), NOW)


@_register("ingest_listing", _FILES + """select council_id, case when supplier = '' then 'Redacted' else supplier end as supplier_name, amount, date, month, case when council_id % 3 = 0 then place else '' end as directorate,
  case when council_id % 3 = 1 then place else '' end as service, y || '-' || lpad(((y + 1) % 100)::varchar, 2, '0') as fy, file as source_file from good""")
def _ingest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction of the ledger with its supplier and source file, after the files came in twice."""
    ledger, _, _ = _ingested(spark, sf_dir)
    t = ledger.tables()
    names = t["suppliers"].select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    files = t["source_documents"].select(F.col("id").alias("source_document_id"), F.col("filename").alias("source_file"))
    rows = t["transactions"].join(names, "supplier_id", "left").join(files, "source_document_id", "left")
    return rows.select("council_id", "supplier_name", F.col("amount").cast("double").alias("amount"), "date", "month", "directorate", "service", "fy", "source_file")


_register("ingest_run", _FILES + """, n as (select council_id, count(*) as n, sum(skipped) as skipped, count(distinct part) as files from r group by 1)
select council_id, files as discovered, files as "new", case when council_id % 3 = 2 then 0 else n - skipped end::bigint as inserted, case when council_id % 3 = 2 then n else skipped end::bigint as skipped,
  case when council_id % 3 = 2 then files else 0 end::bigint as errors, case when council_id % 3 = 2 then 'failing' else 'active' end as status from n""")(lambda s, d: _ingested(s, d)[1])
_register("ingest_run_again", _FILES + """, n as (select council_id, count(*) as n, count(distinct part) as files from r group by 1)
select council_id, files as discovered, case when council_id % 3 = 2 then files else 0 end::bigint as "new", 0::bigint as inserted, case when council_id % 3 = 2 then n else 0 end::bigint as skipped,
  case when council_id % 3 = 2 then files else 0 end::bigint as errors, case when council_id % 3 = 2 then 'failing' else 'active' end as status from n""")(lambda s, d: _ingested(s, d)[2])
_register("ingest_totals", _FILES + """select (select count(*) from good)::bigint as inserted, (select count(distinct (council_id, part)) from c where council_id % 3 = 2)::bigint as errors""")(lambda s, d: R.run_totals(_ingested(s, d)[1]))
_register("ingest_years", _FILES + """, y as (select distinct council_id, y from good union select distinct council_id, case when council_id % 2 = 0 then 2024 else 2022 end from c where council_id % 3 <> 2)
select council_id, y || '-' || lpad(((y + 1) % 100)::varchar, 2, '0') as label, y || '-04-01' as start_date, (y + 1) || '-03-31' as end_date from y""")(
    lambda s, d: _ingested(s, d)[0].table("financial_years").drop("id"))
_register("ingest_documents", _FILES + """select distinct council_id, file as filename, 'https://council/' || council_id || '/' || part as url, case when council_id % 2 = 0 then 'expenditure' else 'procurement_card' end as type, case when council_id % 2 = 0 then '2024-25' else '2022-23' end as fy from c where council_id % 3 <> 2""")(
    lambda s, d: _ingested(s, d)[0].table("source_documents").select("council_id", "filename", "url", "type", "fy"))


@_register("registry_after_run", "select n_nationkey::bigint as id, lower(n_name) as slug, case when n_nationkey in (select c_nationkey from customer) then case when n_nationkey % 3 = 2 then 'failing' else 'active' end else 'pending' end as status, case when n_nationkey in (select c_nationkey from customer) then '2025-01-01T00:00:00Z' end as last_scraped_at from nation")
def _registry_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry once a run's statistics are noted."""
    ledger = _ledger(spark)
    ledger.write("councils", _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.lit("pending").alias("status")))
    R.note_run(ledger, R.ingest(ledger, landed_files(spark, sf_dir), NOW), NOW)
    return ledger.table("councils").select("id", "slug", "status", "last_scraped_at")


# --- files of bounded size: customers of a nation by hundreds; every fifth lacks a column, and profiles name headers that nothing else tells

def parted_files(spark: SparkSession, sf_dir: str, council_id: int | None = None, factor: int = 1) -> DataFrame:
    """Landed files of all councils, or of one; amounts times a factor. A file is as large at any scale, the files are as many as the customers need."""
    c = _read(spark, sf_dir, "customer").withColumn("part", F.expr("c_custkey div 100"))
    c = c if council_id is None else c.filter(F.col("c_nationkey") == council_id)
    line = F.concat_ws(",", F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string")), F.concat(F.lit("S"), (F.col("c_custkey") % 40).cast("string")), (F.col("c_custkey") * factor).cast("string"))
    files = c.groupBy(F.col("c_nationkey").cast("long").alias("council_id"), "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x.line), "\n").alias("body"))
    bad = F.col("part") % 5 == 3
    head = F.when(bad, "Link,Notes,Other").otherwise("Link,Zeta,Eta")
    return files.select("council_id", F.concat_ws("/", F.lit("https://council"), F.col("council_id").cast("string"), F.col("part").cast("string")).alias("url"), F.lit("spend-2024-05.csv").alias("filename"),
                        F.concat(head, F.lit("\n"), F.col("body")).cast("binary").alias("content"), F.lit('{"zeta": "supplier", "eta": "amount", "link": "supplier"}').alias("profile"))


_PARTS = """
with c as (select c_nationkey::bigint as council_id, c_custkey // 100 as part, c_custkey as k, 'S' || (c_custkey % 40) as supplier from customer), good as (select * from c where part % 5 <> 3 and k <> 0), f as (select distinct council_id, part from c)
"""


def _all_transactions(ledger: Ledger) -> DataFrame:
    t = ledger.tables()
    names = t["suppliers"].select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    return t["transactions"].join(names, "supplier_id", "left").groupBy("council_id", "supplier_name").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@_register("ingest_profiles", _PARTS + "select council_id, supplier as supplier_name, count(*) as n, sum(k)::double as total from good group by 1, 2")
def _ingest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that only their profile maps; of two overrides for a field the first counts."""
    ledger = _ledger(spark)
    R.ingest(ledger, parted_files(spark, sf_dir), NOW)
    return _all_transactions(ledger)


@_register("reload_council", _PARTS + "select council_id, supplier as supplier_name, count(*) as n, sum(k * case when council_id = 7 then 3 else 1 end)::double as total from good group by 1, 2")
def _reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One council's files come again with other amounts, and take the place of what it had."""
    ledger = _ledger(spark)
    R.ingest(ledger, parted_files(spark, sf_dir), NOW)
    R.reload_council(ledger, 7, parted_files(spark, sf_dir, 7, 3), NOW)
    return _all_transactions(ledger)


@_register("open_failures", _PARTS + """select council_id, 'https://council/' || council_id || '/' || part as url, 'spend-2024-05.csv' as filename, count(*) as n_rows, 'missing columns amount' as error,
  case when council_id = 7 then 2 else 1 end::bigint as times from c where part % 5 = 3 group by council_id, part""")
def _open_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in quarantine after all files were offered, and one council's twice."""
    ledger = _ledger(spark)
    R.ingest(ledger, parted_files(spark, sf_dir), NOW)
    R.ingest(ledger, parted_files(spark, sf_dir, 7), NOW)
    return R.open_failures(ledger)


@_register("ledger_history", _PARTS + """select t as table_name, n::bigint as "rows" from (values ('transactions', (select count(*) from good)), ('source_documents', (select count(*) from f where part % 5 <> 3)),
  ('quarantine', (select count(*) from f where part % 5 = 3)), ('suppliers', (select count(*) from (select distinct council_id, supplier from good))), ('financial_years', (select count(distinct council_id) from good))) v(t, n)""")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table a run has written, as counted by the writes themselves."""
    ledger = _ledger(spark)
    R.ingest(ledger, parted_files(spark, sf_dir), NOW)
    return ledger.history().filter("kind = 'wrote'").groupBy("table_name").agg(F.sum("rows").alias("rows"))


@_register("compacted_ledger", SPEND_ORACLES["by_category"])
def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending by category after a change for each year of shipping and the packing of what these left."""
    ledger = _ledger(spark)
    transactions = catalog.load(spark, sf_dir)["transactions"]
    for year in range(1990, 2010):
        ledger.write("transactions", transactions.filter(F.year("l_shipdate") == year) if year not in (1990, 2009) else transactions.filter((F.year("l_shipdate") <= 1990) if year == 1990 else (F.year("l_shipdate") >= 2009)))
    ledger.compact("transactions")
    return Q.by_category(ledger.tables())


@_register("scanned_files", """select c_nationkey::bigint as council_id, c_mktsegment as supplier_name, count(*) as n, sum(c_custkey)::double as total from customer where c_custkey <> 0 group by 1, 2""")
def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV files with a header, a folder a nation, and taken in by scans that Spark cuts."""
    path = f"{scratch_dir(spark)}/csv-{uuid4().hex}"
    customers = _read(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("Vendor"), F.col("c_custkey").alias("Net Amount"), F.concat(F.col("c_name"), F.lit(", \"x\"")).alias("Description"))
    customers.write.partitionBy("c_nationkey").option("header", True).option("escape", '"').csv(path)
    files = list_files(spark, path, recursive=True).select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("long").alias("council_id"), F.col("path").alias("url"), "filename", "path", F.lit(None).cast("string").alias("profile"))
    ledger = _ledger(spark)
    R.ingest(ledger, files, NOW, parse=scan_files)
    return _all_transactions(ledger)


# --- publication: source documents made from orders, some of which the target turns away

def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(
        F.when(k % 50 == 0, F.lit(1)).otherwise(k).cast("long").alias("id"), (F.col("o_custkey") % 9).cast("long").alias("council_id"), F.when(k % 7 != 0, F.concat(F.lit("f"), k.cast("string"))).alias("filename"),
        F.lit("u").alias("url"), F.col("o_orderstatus").alias("type"))
    return P.publish_table(rows, "source_documents", shard_rows=20_000)


_register("published_counts", """with r as (select case when o_orderkey % 50 = 0 then 1 else o_orderkey end as id, o_custkey % 9 as council_id, o_orderstatus as type from orders where o_orderkey % 7 <> 0)
select type, count(*) as n from (select *, row_number() over (partition by id) as again from r) where id <> 1 group by 1""")(
    lambda s, d: P.ask_shards(_published(s, d)[0], 'SELECT type, count(*) FROM source_documents WHERE id <> 1 GROUP BY type', "type string, n long").groupBy("type").agg(F.sum("n").alias("n")))
_register("published_rejects", """with r as (select case when o_orderkey % 50 = 0 then 1 else o_orderkey end::bigint as id, o_orderkey % 7 = 0 as bare from orders)
select id, 'NOT NULL constraint failed: source_documents.filename' as error, count(*) as n from r where bare group by 1
union all select 1, 'UNIQUE constraint failed: source_documents.id', count(*) - 1 from r where not bare and id = 1 having count(*) > 1""")(
    lambda s, d: _published(s, d)[1].groupBy(F.get_json_object("row", "$.id").cast("long").alias("id"), "error").agg(F.count("*").alias("n")))


# --- budgets

_register("budget_load", """
with l as (select o_custkey % 4 as council_id, o_orderkey as line_no, case o_custkey % 3 when 0 then '2023-24-budget-book' when 1 then 'statement-of-accounts-2022-23' else 'notes-2023-24' end || '-p' || (o_orderkey // 20000) || '.pdf' as file, o_orderkey % 4 as k from orders),
a as (select *, last_value(case k when 0 then 'Place' end ignore nulls) over w as directorate, max(case when k = 1 then 1 else 0 end) over w as started from l window w as (partition by council_id, file order by line_no rows between unbounded preceding and current row))
select council_id, '2023-24' as fy, directorate, 'Libraries' as service, 1200000.0::double as net, nullif(line_no * 1000.0::double, 0) as other, 'budget' as type from a where k in (2, 3) and directorate is not null and file like '%budget%'
union all select council_id, '2022-23', directorate, 'Libraries', line_no * 1000.0::double, 1200000.0::double, 'outturn' from a where k in (2, 3) and directorate is not null and started = 1 and file like 'statement%'""")(
    lambda s, d: _loaded_budgets(s, d))


def _loaded_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets and outturns after the same books were loaded twice."""
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 4
    line = F.when(k == 0, "PLACE").when(k == 1, "Outturn").otherwise(F.concat(F.lit("Libraries "), key.cast("string"), F.lit(" 1,200")))
    kind = F.col("o_custkey") % 3
    name = F.when(kind == 0, "2023-24-budget-book").when(kind == 1, "statement-of-accounts-2022-23").otherwise("notes-2023-24")
    name = F.concat(name, F.lit("-p"), F.expr("o_orderkey div 20000").cast("string"), F.lit(".pdf"))  # as many books as the orders need
    lines = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("council_id"), name.alias("file"), key.alias("line_no"), line.alias("line"))
    ledger = _ledger(spark)
    for _ in range(2):
        B.load_budgets(ledger, lines, seed.BUDGET_FOLDER, NOW)
    t = ledger.tables()
    budget = t["budgets"].select("council_id", "fy", "directorate", "service", F.col("net_budget").alias("net"), F.col("gross_budget").alias("other"), F.lit("budget").alias("type"))
    return budget.unionByName(t["outturns"].select("council_id", "fy", "directorate", "service", F.col("net_outturn").alias("net"), F.col("variance").alias("other"), F.lit("outturn").alias("type")))


_register("budget_books", f"""
with b as (select * from (values {", ".join(f"({i}, '{n}')" for i, n in enumerate(seed.BUDGET_BOOKS))}) t(i, filename)),
l as (select filename, c_nationkey::bigint as council_id from orders join customer on o_custkey = c_custkey join b on i = o_custkey % {len(seed.BUDGET_BOOKS)})
select council_id, filename, '{seed.BUDGET_FOLDER}' || filename as url, case when filename like 'statement%' then 'accounts' else 'budget' end as type, case when filename like 'statement%' then substr(filename, 23, 7) else left(filename, 7) end as fy from l group by 1, 2""")(
    lambda s, d: _budget_books(s, d))


def _budget_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published books as every nation's orders fill them, among the documents of the ledger after they were loaded."""
    books = seed.budget_books(spark).withColumn("i", F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(seed.BUDGET_BOOKS) for x in (n, i))), F.col("filename")))
    orders = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = orders.join(books, F.col("o_custkey") % len(seed.BUDGET_BOOKS) == F.col("i")).select(
        F.col("c_nationkey").cast("long").alias("council_id"), F.col("filename").alias("file"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit("Place "), F.col("o_orderkey").cast("string")).alias("line"))
    ledger = _ledger(spark)
    B.load_budgets(ledger, lines, seed.BUDGET_FOLDER, NOW)
    return ledger.table("source_documents").select("council_id", "filename", "url", "type", "fy")


# --- discovery: of four customers one has a catalogue entry, one a page with files, one a page that leads to another, one nothing

def _web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(councils, catalogue answers, pages) made from customers."""
    n = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    site = F.concat(F.lit("https://n"), F.col("id").cast("string"), F.lit(".example"))
    councils = n.select("id", F.when(F.col("id") % 4 <= 1, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("data_gov_id"), F.when(F.col("id") % 4 != 3, F.concat(site, F.lit("/open/"))).alias("transparency_url"), F.when(F.col("id") % 8 == 1, F.lit("ledger q\\d")).alias("file_pattern"))
    resource = lambda url, form, at: F.struct(F.concat(site, F.lit(url)).alias("url"), F.lit("Spend May").alias("name"), F.lit(form).alias("format"), F.lit(at).cast("string").alias("last_modified"), F.lit("2024-01-01").alias("created"))
    body = F.when(F.col("id") % 4 == 0, F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(resource("/a%20b+c.csv?x=1", " CSV ", "2024-02-02"), resource("/d/", "xlsx", None), resource("/e.pdf", "PDF", None)).alias("resources")).alias("result"))))
    answers = n.filter("id % 4 <= 1").select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("data_gov_id"), F.coalesce(body, F.lit('{"success": true, "result": {"resources": []}}')).alias("json"))
    direct = F.lit('<a href="#">top</a><a href="/f/may%20x.CSV?v=2">May</a><a href="/f/may%20x.CSV?v=2">again</a><a href="mailto:x">m</a><a href="/x/spend-over-500-january">January</a><a href="/r/ledger" >q1</a>')
    leads = F.concat(F.lit('<p><a href="/sub/2024">Spending 2024</a><a href="/sub/none">Payments archive</a><a href="'), site, F.lit('/x.pdf">Spend May</a>'))
    start = n.filter("id % 4 IN (0, 1, 2)").select(F.concat(site, F.lit("/open/")).alias("url"), F.when(F.col("id") % 4 == 2, leads).otherwise(direct).alias("html"))
    below = n.filter("id % 4 = 2").select(F.concat(site, F.lit("/sub/2024")).alias("url"), F.lit('<a href="files/one.xlsx">one</a><a href="/sub/2025">Spending 2025</a>').alias("html"))
    return councils, answers, start.unionByName(below)


_SITE = "'https://n' || c_custkey || '.example'"
_register("discover_dispatch", f"""
select c_custkey::bigint as id, {_SITE} || '/a%20b+c.csv?x=1' as url, 'a-b+c.csv' as filename, 'csv' as format, '2024-02-02' as modified from customer where c_custkey % 4 = 0
union all select c_custkey::bigint, {_SITE} || '/d/', 'spend-may.xlsx', 'xlsx', '2024-01-01' from customer where c_custkey % 4 = 0
union all select c_custkey::bigint, {_SITE} || '/f/may%20x.CSV?v=2', 'may-x.CSV', 'csv', null from customer where c_custkey % 4 = 1
union all select c_custkey::bigint, {_SITE} || '/x/spend-over-500-january', 'spend-over-500-january.csv', 'csv', null from customer where c_custkey % 4 = 1
union all select c_custkey::bigint, {_SITE} || '/r/ledger', 'ledger.csv', 'csv', null from customer where c_custkey % 8 = 1
union all select c_custkey::bigint, {_SITE} || '/files/one.xlsx', 'one.xlsx', 'xlsx', null from customer where c_custkey % 4 = 2""")(lambda s, d: discovery.discover_files(*_web(s, d)))
_register("legacy_links", f"select {_SITE} || '/f/may%20x.CSV?v=2' as url, 'may-x.CSV' as filename from customer where c_custkey % 4 in (0, 1) union all select {_SITE} || '/files/one.xlsx', 'one.xlsx' from customer where c_custkey % 4 = 2")(
    lambda s, d: discovery.legacy_links(_web(s, d)[2]))


@_register("package_search", """select 'id' || c_custkey as data_gov_id, 'title ' || c_custkey as title, case c_custkey % 3 when 0 then 'Org ' || c_custkey when 1 then 'org-' || c_custkey else '' end as org from customer where c_custkey % 5 <> 4""")
def _package_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries' answers by hundreds, the second of which has every package again under another title."""
    n = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_custkey").alias("i"))
    org = F.struct(F.when(F.col("i") % 3 == 0, F.concat(F.lit("Org "), "k")).when(F.col("i") % 3 == 1, "").alias("title"), F.when(F.col("i") % 3 == 1, F.concat(F.lit("org-"), "k")).alias("name"))
    form = F.array(F.struct(F.lit("PDF").alias("format")), F.struct(F.when(F.col("i") % 5 != 4, F.lit(" Xlsx")).alias("format")))
    answers = [n.groupBy(F.expr("i div 100").alias("page")).agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("id"), "k").alias("id"), F.concat(F.lit(title), "k").alias("title"), org.alias("organization"), form.alias("resources")))).alias("results")).select(
        F.lit(q).alias("query_no"), (F.col("page") * 100).cast("long").alias("offset"), F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.lit(25).alias("count"), "results").alias("result"))).alias("json")) for q, title in ((0, "title "), (1, "other "))]
    return discovery.search_packages(reduce(DataFrame.unionByName, answers))


_TYPES = ("text/csv; charset=utf-8", "application/vnd.ms-excel", "application/octet-stream", "text/plain", "application/x-excel", "")
_register("landed_names", """with t as (select o_orderkey, case when o_orderkey % 7 = 0 then 'a.CSV' else 'spend' end as name, o_orderkey % 6 as k from orders)
select o_orderkey, case when name = 'a.CSV' then name else name || case k when 0 then '.csv' when 1 then '.xls' when 3 then '.csv' when 4 then '.xlsx' else '' end end as name from t""")(
    lambda s, d: _read(s, d, "orders").select("o_orderkey", discovery.landed_name(F.when(F.col("o_orderkey") % 7 == 0, "a.CSV").otherwise("spend"), F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("name")))
_CURATED = ", ".join(f"('{n}', '{g}', {repr(seed.PAGES[g]) if g in seed.PAGES else 'null'})" for n, g, _ in seed.COUNCILS)


@_register("curated_registry", f"""
with o as (select * from (values {_CURATED}) t(name, slug, url)), k as (select case when n_nationkey < {len(seed.COUNCILS)} and n_nationkey % 3 = 0 then (select slug from (select slug, row_number() over () - 1 as i from o) where i = n_nationkey) else lower(n_name) end as slug, n_name as name, n_nationkey as i, n_nationkey % 2 = 0 as bare from nation)
select coalesce(k.slug, o.slug) as slug, coalesce(k.name, o.name) as name, coalesce(case when not k.bare then 'https://' || k.slug end, o.url) as url, case when coalesce(k.slug, o.slug) = 'kirklees' then 'active' when k.slug is not null then 'known' else 'pending' end as status from k full join o on k.slug = o.slug""")
def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated councils offered to a registry of nations, some of which stand in it by their slugs; half of these have a page."""
    curated = seed.curated_councils(spark)
    own = F.element_at(F.array(*(F.lit(c[1]) for c in seed.COUNCILS)), (F.least(F.col("n_nationkey"), F.lit(len(seed.COUNCILS) - 1)) + 1).cast("int"))
    slug = F.when((F.col("n_nationkey") < len(seed.COUNCILS)) & (F.col("n_nationkey") % 3 == 0), own).otherwise(F.lower("n_name"))
    known = _read(spark, sf_dir, "nation").select(slug.alias("slug"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("https://"), slug)).alias("url"), F.lit(None).cast("string").alias("data_gov_id"), F.lit("known").alias("status"))
    return I.upsert_registry(known, curated.withColumn("data_gov_id", F.lit(None).cast("string")), "kirklees").select("slug", "name", "url", "status")


# --- the stored ledger

def _stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The view over star-schema tables, written into a stored ledger and read from it."""
    path = f"{scratch_dir(spark)}/ledger-{uuid4().hex}"
    catalog.store(catalog.load(spark, sf_dir), path, "view")
    return catalog.stored(spark, path)


def _of_the_view() -> None:
    """Questions that have been asked of the view, asked of the stored ledger: the same oracles."""
    from civicledger.plans.flags import all_flags

    for name, ask in (("top_suppliers", Q.top_suppliers), ("monthly_trend", Q.monthly_trend), ("flags_all", all_flags)):
        _register(f"stored_{name}", SPEND_ORACLES[name])(lambda spark, sf_dir, ask=ask: ask(_stored(spark, sf_dir)))


_of_the_view()


@_register("stored_tx_search", SPEND_ORACLES["tx_search"])
def _stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search, of which only files are read whose signatures have all pieces of what is looked for."""
    ledger = Ledger(spark, f"{scratch_dir(spark)}/ledger-{uuid4().hex}")
    catalog.store(catalog.load(spark, sf_dir), ledger.path, "view")
    search.sign(ledger)
    return Q.transactions_page(search.searchable(ledger, "R_nG"), 6, filters=Q.Filters(search="R_nG"))


@_register("stored_tx_search_rare", BASE + "select council_id, count(*) as n, sum(amount)::double as total from tx where lower(service) like '%brand#4%' or lower(description) like '%brand#4%' group by 1")
def _stored_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for what stands in one change alone: the transactions of some brands came in by themselves."""
    ledger = _ledger(spark)
    transactions = catalog.load(spark, sf_dir)["transactions"]
    rare = F.coalesce(F.col("service").startswith("Brand#4"), F.lit(False))
    for rows in (transactions.filter(rare), transactions.filter(~rare)):
        ledger.write("transactions", rows)
    search.sign(ledger)
    t = search.searchable(ledger, "BRAND#4")
    hits = t["transactions"].filter(X.like_ascii(F.col("service"), "BRAND#4") | X.like_ascii(F.col("description"), "BRAND#4"))
    return hits.groupBy("council_id").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


# --- formats

_register("fixed_decimals", """with x as (select o_orderkey, (o_orderkey * 7919 % 100000 - 50000) / 800.0::double as x from orders)
select o_orderkey, case when abs(x) * 4 = floor(abs(x) * 4) and (abs(x) * 4)::bigint % 2 = 1 then printf('%.1f', x + sign(x) * 0.01) else printf('%.1f', x) end as one, printf('%.0f', round(x)) as none from x""")(
    lambda s, d: _fixed(_read(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 % 100000 - 50000) / F.lit(800.0)).alias("x"))))


def _fixed(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", X.to_fixed(F.col("x"), 1).alias("one"), X.to_fixed(F.col("x"), 0).alias("none"))


_register("serial_dates", "select o_orderkey, strftime(date '1899-12-30' + (o_orderkey % 50000 + 61)::int, '%Y-%m-%d') as date, '2024-04' as month, '2024-25' as fy from orders")(
    lambda s, d: I.clean_rows(_read(s, d, "orders").select(F.lit("A").alias("supplier"), F.lit("5").alias("amount"), F.lit("").alias("date"), *(F.lit("").alias(f) for f in I.FIELDS[3:]), F.lit("spend-2024-04.csv").alias("__file"), (F.col("o_orderkey") % 50000 + 61 + 0.25).cast("double").alias("serial"), "o_orderkey"), "o_orderkey", serial="serial")
    .select("o_orderkey", "date", F.lit("2024-04").alias("month"), F.lit("2024-25").alias("fy")))
_register("year_labels", "select distinct strftime(o_orderdate, '%b %Y') as label from orders")(lambda s, d: _read(s, d, "orders").select(X.month_label(F.date_format("o_orderdate", "yyyy-MM"), True).alias("label")).distinct())
_register("legacy_columns", """select c_custkey, case when c_custkey % 3 = 0 then c_name else 'second' end as supplier, case when c_custkey % 4 = 0 then '7' else c_custkey::varchar end as amount from customer""")(
    lambda s, d: I.apply_legacy(_read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("Vendor Name"), F.lit("second").alias(" SUPPLIER "), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).otherwise(0).cast("int").alias("Amount"), F.lit(7).alias("amount paid")))
    .select("c_custkey", F.col("legacy_supplier").alias("supplier"), F.col("legacy_amount").alias("amount")))


@_register("export_file", BASE + """select '"' || array_to_string([replace(x, '"', '""') for x in [coalesce(supplier_name, ''), printf('%.2f', amount::double), date, coalesce(directorate, ''), service, coalesce(category, ''), description, 'spend-' || month || '.csv']], '","') || '"' as line
  from (select * from named where council_id = 6 order by named.amount desc, """ + ORDER + """ limit 50) named union all select '"Supplier","Amount","Date","Directorate","Service","Category","Description","Source File"'""")
def _export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the exported file."""
    path = f"{scratch_dir(spark)}/export-{uuid4().hex}/{P.export_name('nation-6', None)}"
    P.export_page(Q.transactions_page(catalog.load(spark, sf_dir), 6), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@_register("export_page", BASE + """select coalesce(supplier_name, '') as "Supplier", printf('%.2f', amount::double) as "Amount", date as "Date", coalesce(directorate, '') as "Directorate", service as "Service", coalesce(category, '') as "Category",
  description as "Description", 'spend-' || month || '.csv' as "Source File" from named where council_id = 6 order by named.amount desc, """ + ORDER + " limit 50")
def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a page's export."""
    return P.export_columns(Q.transactions_page(catalog.load(spark, sf_dir), 6))
