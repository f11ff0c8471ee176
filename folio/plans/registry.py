"""Queries register here, each with DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def tables(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...] | DataFrame:
    found = tuple(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names)
    return found[0] if len(found) == 1 else found


def run_sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """Spark SQL over views of the tables that text names."""
    for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        if n in text:
            spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return spark.sql(text, args=args or None)
