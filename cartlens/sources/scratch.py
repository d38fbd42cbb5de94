"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below `spark.checkpoint.dir`; only a local session without it gets a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='cartlens-')}"
        spark.sparkContext.setCheckpointDir(place)
    return f"{place.rstrip('/')}/cartlens-{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str, scratch: str | None = None) -> DataFrame:
    """Write a table once and read it from there: lineage ends, and every reader sees the same rows."""
    path = f"{scratch.rstrip('/')}/{name}" if scratch else scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
