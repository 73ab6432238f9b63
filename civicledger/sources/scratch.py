"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session that names none.
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own.setdefault("dir", "") or "file://" + tempfile.mkdtemp(prefix="civicledger-")
        _own["dir"] = found
    return f"{found.rstrip('/')}/civicledger"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, lineage ends there."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
