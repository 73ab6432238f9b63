"""Incremental ingestion: a file stream whose checkpoint is the ledger of files already taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civicledger.operators.headers import Mapping
from civicledger.operators.ingest import apply_mapping, clean_rows
from civicledger.operators.runs import ingest, note_run
from civicledger.operators.warehouse import Ledger


def ingest_new_files(ledger: Ledger, folder: str, council_id: int, checkpoint: str, now: str, profile: str | None = None) -> StreamingQuery:
    """Takes what files of any header signature have come into a folder since the last run into the stored ledger, then stops.

    Exactly once: each of the stream's batches is one change of the ledger, whose note names the checkpoint and
    the batch. A batch that is offered again after a crash is passed over if its change counts, and leaves nothing
    behind if it doesn't. The council's status and the time are noted in the registry, again with the same result.
    """
    files = ledger.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def take(batch: DataFrame, epoch: int) -> None:
        note = f"stream {checkpoint} {epoch}"
        if ledger.committed(note):
            return
        landed = batch.select(F.lit(council_id).cast("long").alias("council_id"), F.col("path").alias("url"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.lit(profile).cast("string").alias("profile"))
        note_run(ledger, ingest(ledger, landed, now, note=note), now)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new_csv(spark: SparkSession, folder: str, headers: list[str], mapping: Mapping, council_id: int, out: str, checkpoint: str) -> StreamingQuery:
    """Takes in what files of this header signature have come since the last run, then stops."""
    schema = ", ".join(f"`{h}` string" for h in headers)
    raw = spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(folder).na.fill("")
    rows = clean_rows(apply_mapping(raw.withColumn("__file", F.col("_metadata.file_name")), mapping))
    rows = rows.filter("skip IS NULL").drop("skip").withColumn("council_id", F.lit(council_id).cast("long"))
    return rows.writeStream.partitionBy("council_id", "fy").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=out, format="parquet")
