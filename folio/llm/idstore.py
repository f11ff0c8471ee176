"""A content-addressed store of id streams: chunks cut by a rolling hash, stored once, and recipes that rebuild documents.

Files below one folder, all Parquet:
  chunks/     key (BLAKE2b-128 of the payload), n, payload (little-endian ids, 16 bits if the vocabulary allows, else 32);
              each distinct chunk once
  recipes/    doc_id, start (ids of all documents before it), n_tokens, keys, root (Merkle root over doc_id, start and
              n_tokens, then the keys), block; in ascending order of doc_id across and within files (nulls first; ties by keys)
  manifests/  block, first_start, n_docs, n_tokens, root: the Merkle root over the block's document roots, in order
  top/        n_blocks, n_docs, n_tokens and the Merkle root over the blocks' roots: one row

A document is cut after an id where a hash of the last `reach` ids has its low bits zero, so equal passages cut alike whatever
precedes them; chunks have between `least` and `most` ids, but for a document's last. Reading first rebuilds the blocks' roots
from the recipes and compares them with manifests and top, so that a lost, added or exchanged recipe or file is an error;
then it joins recipes with chunks, recomputes every key from its payload and every document's root, and fails on any difference.

Null and empty texts are their end id alone. Repeated rows are documents of their own with the same chunks. An empty table
makes an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import textkernel as K
from folio.llm.common import id_bounds, shared_dir, small_batches, table, with_block, written
from folio.llm.tokens import encoder, vocabulary_path, with_end

U = np.uint64


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


#: A random 64-bit value for each id below 2**16, and for larger ones on demand.
ID_VALUES = K.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def chunk_marks(ids: np.ndarray, at: np.ndarray, average_bits: int = 8, reach: int = 4) -> np.ndarray:
    """Positions after which the rolling hash asks for a cut, in the joined ids of texts that end at at[1:].

    Only the last `reach` ids of the same text and their distance enter, not their place."""
    values = ID_VALUES[ids] if len(ids) and ids.max() < len(ID_VALUES) else K.mix(ids.astype(np.uint64) + U(1))
    rolled = values * U(K.BASE)
    starts = at[:-1][np.diff(at) > 0]
    for k in range(1, reach):
        part = values[: max(len(values) - k, 0)] * U(pow(K.BASE, k + 1, 1 << 64))
        for d in range(k):  # the first ids of a text have none of it so far before them
            across = starts[(starts >= k - d) & (starts + d < len(ids))] + d
            part[across - k] = 0
        rolled[k:] += part
    return np.flatnonzero(rolled >> U(64 - average_bits) == 0) + 1


def chunk_ends(marks: list[int], n: int, least: int = 64, most: int = 1024) -> list[int]:
    """The ends of the chunks of a text of n ids, the last being n."""
    cuts, at = [], 0
    for mark in [*marks, n]:
        while mark - at > most:
            at += most
            cuts.append(at)
        if mark - at >= least and mark < n:
            at = mark
            cuts.append(at)
    if not cuts or cuts[-1] < n:
        cuts.append(n)
    return cuts


def encoded(docs: DataFrame, vocabulary: str | None, end_id: int, wide: bool) -> DataFrame:
    """(doc_id, n_tokens, keys, sizes, payloads) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary or vocabulary_path("word_bpe_49k.json"))
        if not wide and coder.vocabulary_size > 1 << 16:
            raise ValueError("this vocabulary needs wide=True")
        width = "<u4" if wide else "<u2"
        for batch in batches:
            ids, at = with_end(*coder.encode_batch(batch.column("text")), end_id)
            marks = chunk_marks(ids, at)
            split = np.searchsorted(marks, at, "right")
            raw, size = memoryview(ids.astype(width).tobytes()), 4 if wide else 2
            totals, keys, sizes, payloads = np.diff(at).tolist(), [], [], []
            for i, start in enumerate(at[:-1].tolist()):
                cuts = [0, *chunk_ends((marks[split[i] : split[i + 1]] - start).tolist(), totals[i])]
                parts = [bytes(raw[size * (start + a) : size * (start + b)]) for a, b in zip(cuts, cuts[1:], strict=False)]
                keys.append([digest(x) for x in parts])
                sizes.append([b - a for a, b in zip(cuts, cuts[1:], strict=False)])
                payloads.append(parts)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(totals, pa.int64()),
                    pa.array(keys, pa.list_(pa.binary())),
                    pa.array(sizes, pa.list_(pa.int32())),
                    pa.array(payloads, pa.list_(pa.binary())),
                ], names=["doc_id", "n_tokens", "keys", "sizes", "payloads"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, keys array<binary>, sizes array<int>, payloads array<binary>",
    )


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node goes up unchanged; no leaves: the hash of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def document_root(doc_id: int | None, start: int, n_tokens: int, keys: list[bytes]) -> bytes:
    return merkle([digest(repr((doc_id, start, n_tokens)).encode()), *keys])


def _with_roots(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [document_root(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "keys")), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "root"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, keys array<binary>, block int, root binary")


def _block_roots(recipes: DataFrame) -> DataFrame:
    """manifests of recipes. The rows of a block come one after another, in order, and only a path of the tree is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def close() -> pa.RecordBatch:
            root = b""
            for _, node in reversed(now["path"]):  # open subtrees, smallest first
                root = digest(node + root) if root else node
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([now["block"]], pa.int32()),
                    "first_start": pa.array([now["start"]], pa.int64()),
                    "n_docs": pa.array([now["docs"]], pa.int64()),
                    "n_tokens": pa.array([now["tokens"]], pa.int64()),
                    "root": pa.array([root], pa.binary()),
                }
            )

        for batch in batches:
            for row in batch.to_pylist():
                if now and now["block"] != row["block"]:
                    yield close()
                    now = None
                now = now or {"block": row["block"], "start": row["start"], "docs": 0, "tokens": 0, "path": []}
                now["docs"] += 1
                now["tokens"] += row["n_tokens"]
                node = (0, row["root"])
                while now["path"] and now["path"][-1][0] == node[0]:
                    node = (node[0] + 1, digest(now["path"].pop()[1] + node[1]))
                now["path"].append(node)
        if now:
            yield close()

    ordered = recipes.select("block", "start", "n_tokens", "root").repartition("block").sortWithinPartitions("block", "start")
    return ordered.mapInArrow(run, "block int, first_start long, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, wide: bool = False) -> None:
    """Encodes all rows of docs (doc_id, text) into a store at path, which must be a folder that all executors see."""
    spark = docs.sparkSession
    rows = written(encoded(docs, vocabulary, end_id, wide), "encoded", compression="zstd")
    chunks = rows.select(F.explode(F.arrays_zip("keys", "sizes", "payloads")).alias("c")).select(
        F.col("c.keys").alias("key"), F.col("c.sizes").alias("n"), F.col("c.payloads").alias("payload"),
    )
    chunks.dropDuplicates(["key"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    small_batches(spark, 4000)  # no texts from here on
    light = with_block(rows.select("doc_id", "n_tokens", "keys"), id_bounds(rows.select("doc_id")))
    totals = light.groupBy("block").agg(F.sum("n_tokens").alias("tokens"))  # one row a block, of a bounded number of blocks
    before = totals.select(
        "block", F.coalesce(F.sum("tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "keys")
    placed = light.withColumn("inside", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    recipes = placed.join(F.broadcast(before), "block").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "keys", "block")
    _with_roots(recipes.repartitionByRange("block").sortWithinPartitions("start")).write.parquet(f"{path}/recipes")
    _block_roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifests")
    blocks = _blocks(spark.read.parquet(f"{path}/manifests"))
    spark.createDataFrame([_top(blocks)], "n_blocks long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/top")


def _blocks(manifests: DataFrame) -> dict[int, tuple]:
    """Manifests on the driver: a row a block, of which there are at most 20,000 (see id_bounds)."""
    return {r["block"]: (r["first_start"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in manifests.collect()}


def _top(blocks: dict[int, tuple]) -> tuple[int, int, int, bytes]:
    ordered = [blocks[b] for b in sorted(blocks)]
    return len(ordered), sum(x[1] for x in ordered), sum(x[2] for x in ordered), merkle([x[3] for x in ordered])


def check_manifests(spark: SparkSession, path: str) -> None:
    """Raises unless the recipes give the blocks of manifests/, these the row of top/, and the blocks follow each other gaplessly."""
    small_batches(spark, 4000)
    fresh, kept = _blocks(_block_roots(spark.read.parquet(f"{path}/recipes"))), _blocks(spark.read.parquet(f"{path}/manifests"))
    top = spark.read.parquet(f"{path}/top").collect()
    if len(top) != 1 or (*top[0][:3], bytes(top[0]["root"])) != _top(kept):
        raise ValueError("manifests and top differ")
    if wrong := sorted(b for b in {*fresh, *kept} if fresh.get(b) != kept.get(b)):
        raise ValueError(f"recipes and manifests differ in {len(wrong)} blocks, the first being {wrong[0]}")
    at = 0
    for b in sorted(kept):
        if kept[b][0] != at:
            raise ValueError(f"block {b} begins at {kept[b][0]}, not at {at}")
        at += kept[b][2]


# CRC-32 of joined byte strings from the parts' CRCs: appending zero bytes is linear over the 32 bits.
def _append_one_zero() -> np.ndarray:
    """Images of the 32 unit vectors when a zero byte is appended, as in CRC-32 with the reflected polynomial."""
    cols = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        cols.append(c)
    return np.array(cols, np.uint32)


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1) == 1, columns[bit], np.uint32(0))
    return out


def crc_after(values: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What CRCs add to the CRC of a longer string, in which n_bytes follow theirs."""
    out, left, columns = values.astype(np.uint32), n_bytes.astype(np.int64), _append_one_zero()
    while (left > 0).any():
        odd = (left & 1) == 1
        if odd.any():
            out[odd] = _apply(columns, out[odd])
        columns, left = _apply(columns, columns), left >> 1
    return out


def _checked_chunks(chunks: DataFrame, wide: bool) -> DataFrame:
    """(key, n, crc) of the stored chunks; crc is over 32-bit ids. A payload that isn't its key's is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 4 if wide else 2
        for batch in batches:
            payloads = batch.column("payload")
            at = np.frombuffer(payloads.buffers()[1], np.int32, len(payloads) + 1, payloads.offset * 4).astype(np.int64)
            raw = memoryview(payloads.buffers()[2])[at[0] : at[-1]] if len(payloads) else memoryview(b"")
            lengths = np.asarray(batch.column("n"), np.int64)
            if (np.diff(at) != lengths * size).any():
                raise ValueError("a chunk has not its length")
            ids = memoryview(np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4").tobytes())
            cuts = ((at - at[0]) // size).tolist()
            crcs = []
            for key, a, b in zip(batch.column("key").to_pylist(), cuts, cuts[1:], strict=False):
                if digest(raw[size * a : size * b]) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                crcs.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.record_batch([batch.column("key"), batch.column("n"), pa.array(crcs, pa.int64())], names=["key", "n", "crc"])

    return chunks.select("key", "n", "payload").mapInArrow(run, "key binary, n int, crc long")


def read_digests(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Every manifest, recipe and chunk is read and verified once; a document's CRC comes from those of its chunks' ids, so payloads
    need no shuffle."""
    check_manifests(spark, path)
    small_batches(spark, 4000)  # no texts here
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("keys").alias("place", "key"))
    chunks = _checked_chunks(spark.read.parquet(f"{path}/chunks"), wide)
    joined = parts.join(chunks, "key", "left").groupBy("start").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_tokens").alias("n_tokens"),
        F.first("root").alias("root"),
        F.array_sort(F.collect_list(F.struct("place", "key", "n", "crc"))).alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            at = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            flat = lists.flatten()
            if flat.field("n").null_count:
                raise ValueError("a chunk is missing")
            n, crc = np.asarray(flat.field("n"), np.int64), np.asarray(flat.field("crc"), np.int64).astype(np.uint32)
            keys = flat.field("key").to_pylist()
            sums = np.concatenate([[0], np.cumsum(n)])
            total = np.diff(sums[at])
            if (total != np.asarray(batch.column("n_tokens"), np.int64)).any():
                raise ValueError("a document's chunks don't have its length")
            recipes = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root")), strict=True)
            for i, (doc_id, start, n_tokens, root) in enumerate(recipes):
                if document_root(doc_id, start, n_tokens, keys[at[i] : at[i + 1]]) != root:
                    raise ValueError("a recipe is damaged")
            after = np.repeat(sums[at[1:]], np.diff(at)) - sums[1:]
            shifted = crc_after(crc, 4 * after)
            whole = np.bitwise_xor.reduceat(shifted, at[:-1]) if len(shifted) else np.empty(0, np.uint32)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(whole.astype(np.int64))],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return joined.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, ids array<long>): every document's ids, put together again from its chunks."""
    check_manifests(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("keys").alias("place", "key"))
    small_batches(spark)
    joined = recipes.join(spark.read.parquet(f"{path}/chunks"), "key").groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("place", "payload"))).alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(
                b"".join(x["payload"] for x in parts), "<u4" if wide else "<u2",
            ).astype(np.int64) for parts in batch.column("parts").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return joined.select("doc_id", "start", "parts").mapInArrow(run, "doc_id long, start long, ids array<long>")


def verify_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(block, ok): whether each block's Merkle root, recomputed from the recipes, is the one in its manifest."""
    small_batches(spark, 4000)
    fresh = _block_roots(spark.read.parquet(f"{path}/recipes")).select(F.col("block").alias("b"), F.col("root").alias("r"), F.col("n_tokens").alias("t"))
    kept = spark.read.parquet(f"{path}/manifests")
    return kept.join(fresh, kept.block == fresh.b, "full").select(
        F.coalesce("block", "b").alias("block"), (F.col("root").eqNullSafe(F.col("r")) & F.col("n_tokens").eqNullSafe(F.col("t"))).alias("ok"),
    )


def op6_content_store(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, start, n_tokens, ids_crc32, read back from a store written for the purpose."""
    path = f"{shared_dir(spark)}/idstore-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
