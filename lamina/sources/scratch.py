"""Tables in the shared scratch folder: they cut lineage in iterative operators and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a local folder serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = tempfile.mkdtemp(prefix="lamina-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/lamina-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table under folder() and read it back."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
