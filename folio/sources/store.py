"""A folder for intermediate tables that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one in local mode (tests), and an error on a cluster."""
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def settled(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a written table, which gives the same rows whenever it is read, and the table's path."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
