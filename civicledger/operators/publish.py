"""Sinks: page export as CSV, and publication as SQL databases with a path for bad rows.

Publication deals a table's rows by key into shards of bounded size. A task puts a shard's rows into an SQLite
database by batches; a batch that fails is taken back and tried again row by row, so only its bad rows
are turned away, each with the database's reason. A shard is one row with the whole database, which Spark writes where
all can read it; equal keys meet in one shard, so what must be unique is so over all shards.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructType

from civicledger.operators.warehouse import SCHEMAS
from civicledger.sources.scratch import materialise

#: Headers of the export, in their order.
EXPORT = ("Supplier", "Amount", "Date", "Directorate", "Service", "Category", "Description", "Source File")
#: Rows of a batch, and about how many go into a shard.
BATCH, SHARD_ROWS = 200, 200_000


@dataclass(frozen=True)
class Target:
    """What a published table demands and is searched by. unique: columns that no two rows share; rows are dealt by them, else by `dealt`."""

    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    dealt: tuple[str, ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()


#: The published tables, referred-to ones first.
TARGETS = {
    "councils": Target(("name", "slug"), ("slug",)),
    "financial_years": Target(("council_id", "label", "start_date", "end_date"), ("id",), indexes=(("council_id",),)),
    "suppliers": Target(("council_id", "name", "normalised_name"), ("id",), indexes=(("council_id", "normalised_name"),)),
    "source_documents": Target(("council_id", "filename", "url", "type"), ("id",), indexes=(("council_id",), ("url",))),
    "budgets": Target(("fy",), dealt=("council_id", "fy"), indexes=(("fy",),)),
    "outturns": Target(("fy",), dealt=("council_id", "fy"), indexes=(("fy",),)),
    "transactions": Target(("council_id", "amount"), dealt=("source_document_id", "file_row"), indexes=(("council_id", "date"), ("supplier_id",), ("council_id", "directorate"), ("council_id", "category"), ("council_id", "month"), ("council_id", "fy"))),
}


def export_columns(page: DataFrame) -> DataFrame:
    """The export's columns of one page of transactions: month where there is no date, '' for nulls."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    date = F.coalesce(F.nullif(F.col("date"), F.lit("")), F.nullif(F.col("month"), F.lit("")), F.lit(""))
    cells = (text("supplier_name"), F.format_string("%.2f", F.col("amount").cast("double")), date, *(text(c) for c in ("directorate", "service", "category", "description", "source_file")))
    return page.select(*(c.alias(name) for c, name in zip(cells, EXPORT)))


def export_name(slug: str, fy: str | None) -> str:
    return f"transactions-{slug}-{fy or 'all'}.csv"


def export_page(page: DataFrame, path: str) -> None:
    """One page of transactions as a CSV file with every field quoted, as commas stand in more than descriptions."""
    export_columns(page).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects with all their columns, nulls too."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def _ddl(name: str, schema: StructType, target: Target) -> list[str]:
    kinds = {LongType: "INTEGER", IntegerType: "INTEGER", DecimalType: "REAL", DoubleType: "REAL"}
    cols = [f'"{f.name}" {kinds.get(type(f.dataType), "TEXT")}' + " NOT NULL" * (f.name in target.required) for f in schema.fields]
    cols += [f"UNIQUE ({', '.join(target.unique)})"] if target.unique else []
    return [f'CREATE TABLE "{name}" ({", ".join(cols)})']


def insert_rows(db, name: str, columns: list[str], rows: Iterator[list[tuple]], batch: int = BATCH) -> Iterator[tuple[tuple, str | None]]:
    """Puts rows, which come in lists, into a table of a DB-API connection with `?` parameters. Yields each row that is turned away, and why."""
    sql = f'INSERT INTO "{name}" ({", ".join(columns)}) VALUES ({", ".join("?" * len(columns))})'
    for some in rows:
        for i in range(0, len(some), batch):
            part, cursor = some[i : i + batch], db.cursor()
            try:
                cursor.executemany(sql, part)
                db.commit()
            except db.Error:
                db.rollback()
                for row in part:
                    try:
                        cursor.execute(sql, row)
                        db.commit()
                    except db.Error as e:
                        db.rollback()
                        yield row, str(e)


def publish_table(rows: DataFrame, name: str, shard_rows: int = SHARD_ROWS, connect: Callable[[], sqlite3.Connection] | None = None) -> tuple[DataFrame, DataFrame]:
    """(shards, rejected) of one of the published tables. shards: table_name, n_rows, database (null if connect leads elsewhere); rejected: table_name, row (JSON), error.

    Columns that rows lack are null; other columns are left out. Repeated rows stay, but where a column must be unique the
    first that comes is kept. connect: makes a connection in a task; by default to a database in memory, which is what a shard holds.
    """
    target, schema = TARGETS[name], StructType.fromDDL(SCHEMAS[name])
    columns = schema.fieldNames()
    cast = lambda f: "double" if isinstance(f.dataType, DecimalType) else f.dataType
    rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(cast(f)).alias(f.name) for f in schema.fields))
    shards = 1 + rows.count() // shard_rows
    dealt = rows.repartition(shards, *(target.unique or target.dealt))

    def load(batches):
        db = connect() if connect else sqlite3.connect(":memory:")
        for sql in _ddl(name, schema, target) if connect is None else ():
            db.execute(sql)
        kept, bad = 0, []

        def lists():
            nonlocal kept
            for b in batches:
                kept += b.num_rows
                yield list(zip(*(c.to_pylist() for c in b.columns)))

        def out(n, database, rejected):
            size = len(rejected) + (n is not None)
            head = ([n], [database], [None], [None]) if n is not None else ([], [], [], [])
            cells = [h + c for h, c in zip(head, ([None] * len(rejected), [None] * len(rejected), [json.dumps(dict(zip(columns, r)), ensure_ascii=False) for r, _ in rejected], [e for _, e in rejected]))]
            return pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.binary()), pa.array(cells[2], pa.string()), pa.array(cells[3], pa.string())], ["table_name", "n_rows", "database", "row", "error"])

        turned_away = 0
        for row in insert_rows(db, name, columns, lists()):
            bad.append(row)
            turned_away += 1
            if len(bad) >= 1000:
                yield out(None, None, bad)
                bad = []
        if connect is None:
            for cols in target.indexes:
                db.execute(f'CREATE INDEX "{name}_{"_".join(cols)}" ON "{name}" ({", ".join(cols)})')
            db.commit()
        yield out(kept - turned_away, db.serialize() if connect is None else None, bad)
        db.close()

    done = materialise(dealt.mapInArrow(load, "table_name string, n_rows long, database binary, row string, error string"), f"published-{name}")
    return done.filter("n_rows IS NOT NULL").select("table_name", "n_rows", "database"), done.filter("error IS NOT NULL").select("table_name", "row", "error")


def ask_shards(shards: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows that a SQL statement gives on every shard's database; what several shards have parts of is still to be summed."""
    names = StructType.fromDDL(schema).fieldNames()

    def ask(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                db = sqlite3.connect(":memory:")
                db.deserialize(data)
                found = db.execute(sql).fetchall()
                db.close()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)

    return shards.select("database").mapInArrow(ask, schema)


def publish(tables: dict[str, DataFrame], base: str, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Writes the shards of the tables that there are to base/<table>. Returns (counts: table_name, accepted, rejected; rejected rows)."""
    counts, rejects = None, None
    for name in (n for n in TARGETS if n in tables):
        shards, rejected = publish_table(tables[name], name, shard_rows)
        shards.write.mode("overwrite").parquet(f"{base}/{name}")
        n = shards.groupBy("table_name").agg(F.sum("n_rows").alias("accepted")).join(rejected.groupBy("table_name").agg(F.count("*").alias("rejected")), "table_name", "left").na.fill(0)
        counts, rejects = (n, rejected) if counts is None else (counts.unionByName(n), rejects.unionByName(rejected))
    if counts is None:
        raise ValueError("there is nothing to publish")
    return counts, rejects
