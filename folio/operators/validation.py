"""Checks of documents before they are written, each a DataFrame of what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.rows import duplicates
from folio.sources.schema import ClassModel, col


class ValidationError(ValueError):
    pass


def with_violations(df: DataFrame, model: ClassModel) -> DataFrame:
    """df with `violations`, the names of the rules that a row breaks. All rules are columns of one scan."""
    rules = [(name, test) for a in model.attributes for name, test in a.violations().items() if a.name in df.columns]
    missing = [f"{a.name}.mandatory" for a in model.attributes if a.mandatory and a.name not in df.columns]
    found = [F.when(test, F.lit(name)) for name, test in rules] + [F.lit(m) for m in missing]
    broken = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return df.withColumn("violations", broken)


def rule_counts(df: DataFrame, model: ClassModel) -> DataFrame:
    """(rule, rows): how many rows break each rule that is broken at all."""
    return with_violations(df, model).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def missing_targets(df: DataFrame, column: str, target: DataFrame, key: str = "_id") -> DataFrame:
    """Rows whose non-null foreign key has no document in target."""
    return df.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def key_clashes(fresh: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Key combinations that occur twice in fresh, or in fresh and stored."""
    within = duplicates(fresh, keys).select(*keys)
    if stored is None:
        return within
    same = reduce(lambda a, b: a & b, (fresh[k].eqNullSafe(stored[k]) for k in keys))
    return within.unionByName(fresh.join(stored, same, "left_semi").select(*keys)).distinct()


def ensure_valid(df: DataFrame, model: ClassModel, stored: DataFrame | None = None) -> None:
    """Raises if any row breaks a rule or a primary key occurs twice; one bad document rejects the call."""
    bad = with_violations(df, model).where(F.size("violations") > 0).select("violations").limit(1).collect()
    if bad:
        raise ValidationError(f"{model.name}: {', '.join(bad[0]['violations'])}")
    if model.primary_key and key_clashes(df, stored, model.primary_key).limit(1).count():
        raise ValidationError(f"{model.name}: duplicate document by keys {model.primary_key}")


def fill_defaults(df: DataFrame, model: ClassModel) -> DataFrame:
    """df with every attribute of the model: missing columns are added, nulls get the default where there is one."""
    columns = {}
    for a in model.attributes:
        default = F.lit(a.default).cast(a.spark_type()) if a.default is not None else F.lit(None).cast(a.spark_type())
        if a.name not in df.columns:
            columns[a.name] = default
        elif a.default is not None:
            columns[a.name] = F.coalesce(col(a.name), default)
    return df.withColumns(columns) if columns else df


def propagate(df: DataFrame, old: ClassModel, new: ClassModel) -> DataFrame:
    """Documents of old in the shape of new: attributes that went are dropped, new ones get default or null, changed types are cast."""
    gone = [a.name for a in old.attributes if a.name not in {b.name for b in new.attributes}]
    out = fill_defaults(df.drop(*gone), new)
    before = {a.name: a for a in old.attributes}
    casts = {a.name: col(a.name).try_cast(a.spark_type()) for a in new.attributes if a.name in before and before[a.name].spark_type() != a.spark_type()}
    return out.withColumns(casts) if casts else out
