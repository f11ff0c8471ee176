"""JSON selectors as Columns: {"year": {"$gte": 2000}, "$or": [...]} becomes one predicate, which Spark pushes to the scan.

Two-valued: a test of a missing (null) value is false, so $not and $nor are true for it. A dotted name is a path into structs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "string": (T.StringType,),
    "number": (T.NumericType,),
    "boolean": (T.BooleanType,),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def some(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _kind(data_type: T.DataType, kind: str) -> bool:
    if kind == "null":
        return isinstance(data_type, T.NullType)
    if kind not in KINDS:
        raise ValueError(f"unknown $type {kind}")
    return isinstance(data_type, KINDS[kind])


def _type_of(schema: T.DataType, path: str) -> T.DataType:
    for part in path.split("."):
        schema = schema[part].dataType
    return schema


def _test(value: Column, op: str, arg, kind: T.DataType | None) -> Column:
    simple = {
        "$eq": lambda: value.isNull() if arg is None else value == F.lit(arg), "$gt": lambda: value > F.lit(arg), "$gte": lambda: value >= F.lit(arg), "$lt": lambda: value < F.lit(arg), "$lte": lambda: value <= F.lit(arg),
        "$ne": lambda: value.isNotNull() if arg is None else value.isNotNull() & (value != F.lit(arg)),
        "$in": lambda: value.isin(list(arg)), "$nin": lambda: value.isNotNull() & ~value.isin(list(arg)),
        "$exists": lambda: value.isNotNull() if arg else value.isNull(),
        "$regex": lambda: value.rlike(arg), "$mod": lambda: value % F.lit(arg[0]) == F.lit(arg[1]), "$size": lambda: F.size(value) == F.lit(arg),
        "$all": lambda: F.size(F.array_except(F.array(*map(F.lit, arg)), value)) == 0,
        "$elemMatch": lambda: F.exists(value, lambda x: _value(x, arg, kind.elementType if kind else None)),
        "$allMatch": lambda: (F.size(value) > 0) & F.forall(value, lambda x: _value(x, arg, kind.elementType if kind else None)),
        "$type": lambda: value.isNotNull() & F.lit(_kind(kind, arg)) if arg != "null" else value.isNull(),
    }
    if op == "$not":
        return ~_value(value, arg, kind)
    if op not in simple:
        raise ValueError(f"unknown operator {op}")
    return sure(simple[op]())


def _value(value: Column, condition, kind: T.DataType | None) -> Column:
    if isinstance(condition, dict) and condition and all(k.startswith("$") for k in condition):
        return every([_test(value, op, arg, kind) for op, arg in condition.items()])
    if isinstance(condition, dict):
        return every([_value(value[k], v, _type_of(kind, k) if kind else None) for k, v in condition.items()])
    return _test(value, "$eq", condition, kind)


def selector(condition: dict, schema: T.StructType) -> Column:
    """The predicate of a selector over columns of schema."""
    parts = []
    for name, arg in condition.items():
        if name in ("$and", "$or", "$nor"):
            each = [selector(x, schema) for x in arg]
            parts.append({"$and": every, "$or": some, "$nor": lambda e: ~some(e)}[name](each))
        elif name == "$not":
            parts.append(~selector(arg, schema))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        else:
            path = ".".join(f"`{p}`" for p in name.split("."))
            parts.append(_value(F.col(path), arg, _type_of(schema, name)))
    return every(parts)


def find(
    df: DataFrame, condition: dict | None = None, fields: list[str] | None = None, sort: list[str] | None = None, skip: int = 0, limit: int | None = None,
) -> DataFrame:
    """Rows that meet a selector. sort: names, descending with a leading -. A page (skip, limit) needs a sort to be defined."""
    out = df.where(selector(condition or {}, df.schema))
    if sort:
        out = out.orderBy(*(F.col(s[1:]).desc() if s.startswith("-") else F.col(s).asc() for s in sort))
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*fields) if fields else out
