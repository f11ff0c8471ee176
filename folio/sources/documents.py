"""Versioned documents in Parquet: every write appends, the newest revision of an _id is the document.

A class's folder holds new/ with the first revisions of documents and changed/ with the later ones, in each a folder a write,
named by the revision. Reading takes new/ as it is, but for the documents that changed/ has, and the newest rows of changed/.
So filters and columns reach the scan of new/, nothing of it is shuffled as long as the changed ids can be broadcast, and
loading in bulk costs readers nothing. Stack.compact() folds changed/ into new/.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.sources import files
from folio.sources.schema import SYSTEM, ClassModel, col


def latest(log: DataFrame, key: str = "_id", order: str = "_rev") -> DataFrame:
    """The row of highest order for each key. max_by is aggregated before the shuffle, so a key of many revisions is no burden."""
    return log.groupBy(key).agg(
        F.max_by(F.struct(*(col(c) for c in log.columns if c != key)), order).alias("__row")
    ).select(key, "__row.*").select(*(col(c) for c in log.columns))


def merge(old: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """new laid over old: columns that new lacks keep their old value."""
    kept = [c for c in old.columns if c not in new.columns]
    if not kept:
        return new
    return new.join(old.select(key, *(col(c) for c in kept)), key, "left")


class DocumentLog:
    """One class's documents in one folder. A second writer of the same revision gets an error."""

    def __init__(self, spark: SparkSession, path: str, model: ClassModel, struct: T.StructType | None = None):
        self.spark, self.path, self.model = spark, f"{path}/{model.name}", model
        self.struct = struct or model.struct()

    def _read(self, *parts: str) -> DataFrame:
        there = [f"{self.path}/{part}/{number}" for part in parts for number in files.folders(self.spark, f"{self.path}/{part}")]
        return self.spark.read.schema(self.struct).parquet(*there) if there else self.spark.createDataFrame([], self.struct)

    def history(self) -> DataFrame:
        """All revisions."""
        return self._read("new", "changed")

    def documents(self, inactive: bool = False) -> DataFrame:
        live = lambda df: df if inactive else df.where("active")
        if not files.folders(self.spark, f"{self.path}/changed"):
            return live(self._read("new"))
        changed = self._read("changed")
        return live(self._read("new")).join(changed.select("_id"), "_id", "left_anti").unionByName(live(latest(changed)))

    def revision(self) -> int:
        """The last revision, from the folders' names."""
        return max((int(x) for part in ("new", "changed") for x in files.folders(self.spark, f"{self.path}/{part}")), default=0)

    def _write(self, rows: DataFrame, part: str, rev: int) -> None:
        rows.select(*(col(f.name).cast(f.dataType).alias(f.name) for f in self.struct)).write.parquet(f"{self.path}/{part}/{rev:010d}")

    def append(self, docs: DataFrame, active: bool = True) -> int:
        """Writes docs (with _id) as the next revision; columns that they lack are taken from the stored document."""
        rev, now = self.revision() + 1, int(time.time() * 1000)
        new = docs.drop(*(f.name for f in SYSTEM if f.name != "_id" and f.name in docs.columns))
        stamps = {"_rev": F.lit(rev).cast("long"), "~class": F.lit(self.model.name), "active": F.lit(active), "~updateTimestamp": F.lit(now).cast("long")}
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.struct if f.name not in new.columns and f.name not in stamps and f.name != "~createTimestamp"}
        if rev == 1:
            fresh = new
        else:
            stored = self.documents(inactive=True)
            known = stored.select("_id")
            fresh = new.join(known, "_id", "left_anti")
            changed = merge(stored.drop("_rev", "~class", "active", "~updateTimestamp"), new.join(known, "_id", "left_semi"))
            if changed.limit(1).count():
                self._write(changed.withColumns(stamps), "changed", rev)
        if rev == 1 or fresh.limit(1).count():
            first = fresh.dropDuplicates(["_id"]).withColumns(stamps | missing | {"~createTimestamp": F.lit(now).cast("long")})
            self._write(first, "new", rev)
        return rev

    def delete(self, ids: DataFrame) -> int:
        """Marks the documents of ids (_id) inactive."""
        return self.append(self.documents().join(ids.select("_id").distinct(), "_id", "left_semi").select("_id"), active=False)

    def write_compact(self, target: DocumentLog) -> None:
        """Writes the documents, inactive ones too, as the first revisions of target, an empty log. Revisions keep their numbers."""
        target._write(self.documents(inactive=True), "new", max(1, self.revision()))
