"""Files as sources and sinks: Parquet, JSON lines and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A schema given saves JSON and CSV a pass over the data."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return reader.format(kind).load(path)


def export(df: DataFrame, path: str, kind: str = "json", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(kind).save(path)


def class_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The documents of a class kept as one Parquet table below root."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, of any store that Spark reads; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in any store that Spark reads; nothing happens if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
