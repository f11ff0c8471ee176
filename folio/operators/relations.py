"""Relations between classes: cardinality, edges, reference attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.schema import col

EDGE = ["`~domain`", "sourceClass", "targetClass", "sourceId", "targetId"]


@dataclass(frozen=True)
class Domain:
    name: str
    cardinality: str
    source: str
    target: str

    def __post_init__(self) -> None:
        if self.cardinality not in ("1:1", "1:N", "N:1", "N:N"):
            raise ValueError(f"unknown cardinality {self.cardinality}")

    def unique_sides(self) -> list[str]:
        """The edge columns in which an id may occur once."""
        return {"1:1": ["sourceId", "targetId"], "1:N": ["targetId"], "N:1": ["sourceId"], "N:N": []}[self.cardinality]

    def reference_side(self, cls: str) -> str:
        """The side of cls as the holder of a reference attribute; an error where the cardinality forbids it."""
        allowed = {
            "1:1": {self.source: "source", self.target: "target"}, "1:N": {self.target: "target"}, "N:1": {self.source: "source"}, "N:N": {},
        }[self.cardinality]
        if cls not in allowed:
            raise ValueError(f"{cls} can't hold a reference of {self.name} ({self.cardinality})")
        return allowed[cls]


def edges_of(domain: Domain, pairs: DataFrame) -> DataFrame:
    """Edge rows from (sourceId, targetId)."""
    return pairs.select(
        F.lit(domain.name).alias("~domain"),
        F.lit(domain.source).alias("sourceClass"),
        F.lit(domain.target).alias("targetClass"),
        F.col("sourceId").cast("string").alias("sourceId"),
        F.col("targetId").cast("string").alias("targetId"),
    )


def reference_edges(domain: Domain, docs: DataFrame, cls: str, column: str) -> DataFrame:
    """Edges that the reference attribute of docs of class cls stands for."""
    side = domain.reference_side(cls)
    held = docs.where(col(column).isNotNull())
    own, other = F.col("_id"), col(column)
    return edges_of(domain, held.select((own if side == "source" else other).alias("sourceId"), (other if side == "source" else own).alias("targetId")))


def cardinality_clashes(domain: Domain, edges: DataFrame) -> DataFrame:
    """(side, id, n): ids that occur more often than the cardinality allows; equal edges count once."""
    pairs = edges.where(F.col("`~domain`") == domain.name).select("sourceId", "targetId").distinct()
    out = pairs.select(F.lit("").alias("side"), F.lit("").alias("id"), F.lit(0).cast("long").alias("n")).where("false")
    for side in domain.unique_sides():
        out = out.union(pairs.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(side).alias("side"), "id", "n"))
    return out


def broken_edges(domain: Domain, edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Edges of the domain whose classes don't fit or whose documents are missing, with the reason."""
    own = edges.where(F.col("`~domain`") == domain.name)
    wrong = own.where((F.col("sourceClass") != domain.source) | (F.col("targetClass") != domain.target)).withColumn("reason", F.lit("class"))
    lost = [own.join(
        side.select(F.col("_id").alias("__id")), F.col(key) == F.col("__id"), "left_anti",
    ).withColumn("reason", F.lit(key)) for key, side in (("sourceId", source), ("targetId", target))]
    return wrong.unionByName(lost[0]).unionByName(lost[1])


def add_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored and those of fresh that it lacks; adding an edge twice changes nothing."""
    new = fresh.dropDuplicates([c.strip("`") for c in EDGE]).join(
        stored.select("`~domain`", "sourceId", "targetId"), ["~domain", "sourceId", "targetId"], "left_anti",
    )
    return stored.unionByName(new.select(*EDGE))


def remove_edges(stored: DataFrame, domain: str, pairs: DataFrame) -> DataFrame:
    """stored without the domain's edges of the given (sourceId, targetId)."""
    return stored.join(
        pairs.select(F.lit(domain).alias("~domain"), F.col("sourceId").cast("string").alias("sourceId"), F.col("targetId").cast("string").alias("targetId")),
        ["~domain", "sourceId", "targetId"],
        "left_anti",
    )
