"""Change feeds and live results with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folio.sources import files
from folio.sources.documents import DocumentLog, latest

MODELS = "kind string, name string, definition string"


def change_feed(spark: SparkSession, path: str, schema: T.StructType, cls: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The revisions appended to a document log, as a stream; of one class if cls is given."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    feed = reader.parquet(path)
    return feed if cls is None else feed.where(F.col("`~class`") == cls)


def model_feed(spark: SparkSession, path: str) -> DataFrame:
    """The models in a stack's saved catalogs, as a stream: (number, kind, name, definition), kind being class or domain.

    One catalog is one number; the latest number of which any rows are read is the current one."""
    catalogs = spark.readStream.schema("number long, text string").parquet(f"{path}/~catalog")
    of = lambda kind, at: F.transform(F.from_json(F.get_json_object("text", at), "array<string>"), lambda x: F.struct(F.lit(kind).alias("kind"), F.get_json_object(x, "$.name").alias("name"), x.alias("definition")))
    return catalogs.select("number", F.explode(F.concat(of("class", "$.classes"), of("domain", "$.domains"))).alias("m")).select("number", "m.*")


def model_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, change, definition) between two lists of models (kind, name, definition): added, changed or removed."""
    old = before.select("kind", "name", F.col("definition").alias("old"))
    both = after.select("kind", "name", "definition").join(old, ["kind", "name"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("definition").isNull(), "removed").when(F.col("old") != F.col("definition"), "changed")
    return both.select("kind", "name", change.alias("change"), "definition").where("change is not null")


def live_models(spark: SparkSession, path: str, checkpoint: str, tell: Callable[[DataFrame, DataFrame], None], **trigger) -> StreamingQuery:
    """Calls tell(models, changes) for every batch of newly saved catalogs: the current lists of classes and domains, and what is
    new in them since the batch before (model_changes)."""
    last: dict[str, DataFrame] = {}

    def see(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("number")).first()[0]
        if newest is None:
            return
        kept = [tuple(r) for r in batch.where(F.col("number") == newest).select("kind", "name", "definition").collect()]  # models, not documents
        now = spark.createDataFrame(kept, MODELS)
        tell(now, model_changes(last.get("models", spark.createDataFrame([], MODELS)), now))
        last["models"] = now

    return model_feed(spark, path).writeStream.foreachBatch(see).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_view(feed: DataFrame, path: str, checkpoint: str, keep: Column, key: str = "_id", order: str = "_rev", buckets: int = 64, **trigger) -> StreamingQuery:
    """Keeps the current documents that meet keep and, if there is such a column, are active; current(path, batch) reads them.

    Documents are dealt to buckets by a hash of their key. A batch merges the buckets that its rows fall into with their last
    state, writes them to a folder of its own number, and then the list of all buckets' folders; others stay as they are. The
    highest revision of a key wins, then keep is tested anew, so a document that no longer meets it leaves. A batch that is run
    again replaces its own result. Folders that the list before no longer names are deleted."""
    spark = feed.sparkSession
    seen = F.coalesce(keep & F.col("active") if "active" in feed.columns else keep, F.lit(False))

    def merge(batch: DataFrame, number: int) -> None:
        dealt = batch.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in dealt.select("__bucket").distinct().collect()]  # at most `buckets` numbers
        before = _folders(spark, path, number - 1)
        old = [before[b] for b in touched if b in before]
        rows = dealt.unionByName(
            spark.read.schema(dealt.schema).parquet(*(f"{path}/{n}/bucket={b}" for b, n in zip([b for b in touched if b in before], old, strict=True)))
        ) if old else dealt
        now = latest(rows, key, order).withColumns({"__seen": seen, "bucket": F.col("__bucket")})
        now.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{number}")
        after = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(after.items()) or [], "bucket int, folder long").coalesce(1).write.mode("overwrite").parquet(f"{path}/list/{number}")
        for b, n in _folders(spark, path, number - 2).items():
            if before.get(b) != n:
                files.remove(spark, f"{path}/{n}/bucket={b}")
        files.remove(spark, f"{path}/list/{number - 3}")

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The batch in whose folder each bucket is, after batch `number`."""
    if number < 0 or str(number) not in files.folders(spark, f"{path}/list"):
        return {}
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder long").parquet(f"{path}/list/{number}").collect()}


def current(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The live result after batch `number`; None before the first, or where no row has come yet."""
    there = _folders(spark, path, number)
    if not there:
        return None
    return spark.read.parquet(*(f"{path}/{n}/bucket={b}" for b, n in sorted(there.items()))).where("__seen").drop("__seen", "__bucket")


def last_batch(query: StreamingQuery) -> int:
    return (query.lastProgress or {}).get("batchId", -1)


def replicate(feed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 60) -> StreamingQuery:
    """Hands micro-batches to a sink, each at least once and with its number; every so many seconds, or what is there if None."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return feed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_counts(feed: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling windows of event time, in a stream or a table; rows later than the watermark are left out of a stream."""
    return feed.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def into_log(log: DocumentLog) -> Callable[[DataFrame, int], None]:
    """A sink for replicate(): the newest revision of each document is written over the log's, the last writer winning."""

    def write(batch: DataFrame, number: int) -> None:
        now = latest(batch)
        for active in (True, False):
            part = now.where(F.col("active") == active)
            if part.limit(1).count():
                log.append(part, active)

    return write
