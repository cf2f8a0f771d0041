"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from relspan.functions.workers import one_machine


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a local session may do with a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'relspan-checkpoints')}"
    return f"{root.rstrip('/')}/relspan-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to a new table and reads it back: lineage ends there, and a lost executor costs a reread."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
