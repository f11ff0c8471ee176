"""Distinct, union and ordering of rows in the ways the document dialect defines them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(names: list[str]) -> list[Column]:
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in names]


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination of keys, by order (names, descending with a leading -); the result keeps that order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order))))
    return ranked.where("__rank = 1").drop("__rank").orderBy(*_order(order))


def union(parts: list[DataFrame], distinct: bool | list[bool] = True, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A left-associative chain of unions; distinct says of each step whether it removes duplicates of all so far.

    Branches of the same names are united by name, others by position. order and limit hold for the whole."""
    steps = distinct if isinstance(distinct, list) else [distinct] * (len(parts) - 1)

    def step(so_far: DataFrame, nxt: tuple[DataFrame, bool]) -> DataFrame:
        part, once = nxt
        same = set(so_far.columns) == set(part.columns)
        both = so_far.unionByName(part) if same else so_far.union(part)
        return both.distinct() if once else both

    out = reduce(step, zip(parts[1:], steps, strict=True), parts[0])
    out = out.orderBy(*_order(order)) if order else out
    return out.limit(limit) if limit is not None else out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """The combinations of keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def numbered(df: DataFrame) -> DataFrame:
    """df with __part and __row, its partitions' and their rows' numbers. Written, they keep the order of df."""
    return df.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})


def sequential_ids(df: DataFrame, prefix: str, last: int, column: str = "_id") -> DataFrame:
    """df with ids prefix-(last+1), prefix-(last+2), ... Rows are counted by partition; one number a partition passes the driver.

    df has the columns of numbered(), or must give the same partitions again, as a written table does."""
    rows = df if "__part" in df.columns else numbered(df)
    counts = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    starts, at = {}, last
    for part, n in counts:
        starts[part], at = at, at + n
    offsets = df.sparkSession.createDataFrame(list(starts.items()) or [(0, last)], "p int, start long")
    return rows.join(F.broadcast(offsets), F.col("__part") == F.col("p")).withColumn(
        column, F.concat(F.lit(prefix + "-"), (F.col("start") + F.col("__row") + 1).cast("string")),
    ).drop("__part", "__row", "p", "start")
