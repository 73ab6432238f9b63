"""The ledger's tables as DataFrames: stored ones, or a deterministic view over star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicledger.functions.exprs import fy_label

#: Order that has no ties among the view's transactions.
TIEBREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")


def tiebreak(transactions: DataFrame) -> tuple[str, ...]:
    """Columns that order transactions of equal amounts: the view's, or where a stored one came from."""
    return TIEBREAK if TIEBREAK[0] in transactions.columns else ("source_document_id", "file_row")


def stored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the stored ledger under path."""
    from civicledger.operators.warehouse import Ledger

    return Ledger(spark, path).tables()


def store(t: dict[str, DataFrame], path: str, batch: str) -> None:
    """Writes a view's tables into a stored ledger: the fact is joined once, and lies by council and year."""
    from civicledger.operators.warehouse import Ledger

    ledger = Ledger.create(t["transactions"].sparkSession, path)
    with ledger.begin(batch) as change:
        for name in ("councils", "suppliers", "budgets", "outturns"):
            change.add(name, t[name])
        row = F.xxhash64(*TIEBREAK)
        change.add("transactions", t["transactions"].withColumn("batch", F.lit(batch)).withColumn("file_row", row), clustered=True)
        change.add("source_documents", t["source_documents"].withColumn("batch", F.lit(batch)))


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """councils, suppliers, transactions, budgets, outturns and the raw tables under sf_dir. Nothing is read before it is used."""
    raw = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "pages", "documents")}
    place = F.col("n_nationkey") % 4
    councils = raw["nation"].join(raw["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit("-"))).alias("slug"),
        F.col("r_name").alias("region"), F.when(place == 2, "pending").when(place == 3, "failing").otherwise("active").alias("status"))
    kind = F.col("s_suppkey") % 20
    suppliers = raw["supplier"].select(F.col("s_suppkey").alias("id"), F.when(kind == 1, "REDACTED DATA").when(kind == 2, "Redacted Personal Data").when(kind == 3, "redacted misc").otherwise(F.col("s_name")).alias("name"))
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), F.lit(-1.0)).otherwise(F.lit(1.0))
    date, kind = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("p_type")
    # a file for each council and month
    months = F.explode(F.expr("sequence(date'1995-01-01', date'2001-12-01', interval 1 month)"))
    documents = councils.select(F.col("id").alias("council_id"), months.alias("m")).select(
        (F.col("council_id") * 1_000_000 + F.year("m") * 100 + F.month("m")).alias("id"), "council_id", fy_label(F.year("m"), F.month("m")).alias("fy"),
        F.concat(F.lit("spend-"), F.date_format("m", "yyyy-MM"), F.lit(".csv")).alias("filename"), F.concat(F.lit("https://"), F.col("council_id").cast("string"), F.date_format("m", "/yyyy-MM")).alias("url"), F.lit("expenditure").alias("type"))
    lines = raw["lineitem"].join(raw["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(raw["customer"], F.col("o_custkey") == F.col("c_custkey")).join(raw["part"], F.col("l_partkey") == F.col("p_partkey"))
    transactions = lines.select(
        F.col("c_nationkey").cast("long").alias("council_id"), F.when(F.col("l_suppkey") % 20 != 0, F.col("l_suppkey")).alias("supplier_id"),
        (sign * F.col("l_extendedprice") * F.col("l_quantity")).cast("decimal(18,2)").alias("amount"), date.alias("date"), F.substring(date, 1, 7).alias("month"),
        fy_label(F.year("l_shipdate"), F.month("l_shipdate")).alias("fy"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("directorate"),
        F.col("p_brand").alias("service"), F.when(kind.startswith("SMALL"), "").when(kind.startswith("ECONOMY"), "REDACTED DATA").when(~kind.startswith("PROMO"), kind).alias("category"),
        F.col("p_name").alias("description"), (F.col("c_nationkey") * 1_000_000 + F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("source_document_id"), *TIEBREAK)
    orders = raw["orders"].join(raw["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").cast("long").alias("council_id"), fy_label(F.year("o_orderdate"), F.month("o_orderdate")).alias("fy"), F.col("o_orderpriority").alias("directorate"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    plan = orders.agg(F.sum(F.when(F.col("o_orderstatus") != "P", price).otherwise(zero)).alias("net_budget"), F.sum(price).alias("gross_budget"), F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(zero)).alias("net_outturn"))
    return raw | {
        "councils": councils, "source_documents": documents, "suppliers": suppliers, "transactions": transactions,
        "budgets": plan.select("council_id", "fy", "directorate", "net_budget", "gross_budget"),
        "outturns": plan.select("council_id", "fy", "directorate", "net_outturn", (F.col("net_outturn") - F.col("net_budget")).alias("variance")),
    }
