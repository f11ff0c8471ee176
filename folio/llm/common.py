"""What the training-data operators share: tables, written intermediate results, id blocks, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import folio

#: ASCII white space; everything else belongs to words.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class for regular expressions, negated.
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they can import it wherever they run.

    A package that was itself started from an archive (--py-files) is already there."""
    root = Path(folio.__file__).resolve().parent
    if spark.sparkContext.applicationId in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="folio-"), "folio.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, f"folio/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext.applicationId)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Before Python runs in tasks: workers get the package, and Arrow batches are bounded in rows and bytes, so that long texts
    don't pile up in one batch."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception:  # a Spark that has no such setting
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the session's checkpoint folder. Where none is set, a temporary one in local mode (tests), and
    an error on a cluster."""
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, what: str = "step", compression: str = "snappy") -> DataFrame:
    """df, cut off from its lineage by a table in the shared folder; it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, column: str = "doc_id", per_partition: int = 2, most: int = 20_000) -> np.ndarray:
    """Approximate quantiles that divide an integer column into blocks of about equal rows, as many as there are shuffle
    partitions times per_partition. At most `most` numbers reach the driver, whatever the input."""
    n = max(2, min(most, per_partition * parallelism(df.sparkSession)))
    quantiles = df.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n)
    return np.array(sorted({int(x) for x in quantiles}), np.int64)


def with_block(df: DataFrame, bounds: np.ndarray, column: str = "doc_id") -> DataFrame:
    """df with `block`, the number of bounds that are at most the column's value; it ascends with it. Nulls are in block 0."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            block = np.searchsorted(shared.value, np.asarray(values.fill_null(0), np.int64), "right").astype(np.int32)
            block[np.asarray(values.is_null())] = 0
            yield pa.record_batch([*batch.columns, pa.array(block)], names=[*batch.schema.names, "block"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("block", T.IntegerType())]))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of the edges (a, b), a < b, has one edge, to a node that is the larger end of none."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("larger")).union(edges.select(F.col("a").alias("node"), F.lit(0).alias("larger")))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count("*").alias("ends")).where("larger > 0 and ends > 1").count() == 0


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges that is not the least of its connected component: root is that. The edges (a, b), a < b,
    are distinct and a written table.

    Alternating large-star and small-star steps, until all edges lead to a least node; each step's edges are a written table. A
    hub's edges are aggregated by partial minima before the shuffle, and joins are plain inner joins, which Spark splits when skewed."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(rounds):
        if _are_stars(edges):
            break
        # large star: every larger neighbour of a node is linked to the least node of its neighbourhood
        all_ = both(edges)
        least = written(all_.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = all_.join(least, all_.a == least.u).where("b > a").select(F.col("m").alias("a"), "b").where("a != b")
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(least, large.b == least.u).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x != y")
        edges = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The edges (a, b) between different nodes as stars() takes them."""
    return written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its connected component."""
    found = stars(distinct_edges(edges), rounds)
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
