"""Joins of documents: by membership in an array, by equality, through relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fresh(name: str) -> str:
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def array_join(left: DataFrame, right: DataFrame, array: str, key: str = "_id", how: str = "inner") -> DataFrame:
    """left and right where right's key is in left's array: inner, left, right, semi or anti.

    The array is exploded and joined by equality, so Spark hashes or sorts by the key; a predicate with array_contains would
    compare every pair. An id that an array holds twice matches twice (inner, left, right). A left row without match, be its
    array null, empty or of unknown ids, occurs once with nulls (left), and a right row that no array names likewise (right).
    Whether a left row has a match depends on its array's set of items alone: distinct sets, as sorted arrays, are exploded, and
    the left rows meet those that match by an equality of these, so no row needs a number and none is carried through a grouping.
    Sorted, as left is evaluated twice, and collect_list may order an array otherwise each time."""
    clash = set(left.columns) & set(right.columns)
    if clash and how in ("inner", "left", "right"):
        raise ValueError(f"rename the columns {sorted(clash)} of one side first")
    item = _fresh("item")
    items = left.withColumn(item, F.explode(array))
    inner = lambda: items.join(right, F.col(item) == right[key]).drop(item)
    if how == "inner":
        return inner()
    keys = right.select(F.col(key).alias(_fresh("key"))).distinct()
    name = keys.columns[0]
    if how in ("left", "semi", "anti"):
        met = _fresh("met")
        items_of = F.array_sort(F.array_distinct(array))
        arrays = left.select(items_of.alias(met)).where(F.size(met) > 0).distinct().withColumn(item, F.explode(met))
        hits = arrays.join(keys, F.col(item) == F.col(name), "left_semi").select(met).distinct()
        on = items_of == F.col(met)
        if how == "semi":
            return left.join(hits, on, "left_semi")
        lonely = left.join(hits, on, "left_anti")
        return lonely if how == "anti" else inner().unionByName(lonely, allowMissingColumns=True)
    if how == "right":
        named = items.select(F.col(item).alias(name)).distinct()
        return inner().unionByName(right.join(named, right[key] == named[name], "left_anti"), allowMissingColumns=True)
    raise ValueError(f"unknown join {how}")


def keyed_array_match(left: DataFrame, right: DataFrame, array: str, row_key: list[str], key: str = "_id", negate: bool = False) -> DataFrame:
    """left rows with (or, negated, without) a match in right, where row_key identifies a left row: only keys are exploded."""
    hits = left.select(*row_key, F.explode(array).alias("__item")).join(
        right.select(F.col(key).alias("__key")), F.col("__item") == F.col("__key"), "left_semi",
    ).select(*row_key).distinct()
    return left.join(hits, row_key, "left_anti" if negate else "left_semi")


def relation_join(source: DataFrame, edges: DataFrame, target: DataFrame, source_key: str = "_id", target_key: str = "_id") -> DataFrame:
    """source and target documents that active edges (sourceId, targetId) link."""
    e = edges.select("sourceId", "targetId").distinct()
    return source.join(e, source[source_key] == e["sourceId"]).join(target, e["targetId"] == target[target_key]).drop("sourceId", "targetId")
