"""Document fingerprints by a homomorphic multiset hash over paragraphs.

A text is the multiset of its paragraphs (what newlines divide, empty ones included). Each paragraph is hashed to a wide
vector, and a text's fingerprint is the sum of its paragraphs' vectors modulo powers of two, so it doesn't depend on their
order, and a paragraph is inserted or deleted by adding or subtracting its vector. The vector has two parts: 32 lanes of 64
bits from BLAKE2b in counter mode (2048 bits, so that no other multiset of the same sum can be put together by the generalised
birthday attack), whose sum tells multisets apart, and 128 lanes of 32 bits to which each 3-word run of the paragraph (or the
whole of a shorter one) adds +1 or -1 in one lane. The second part is a linear sketch: the cosine of two texts' lanes, read as
signed numbers (exact up to 2**31 runs in a lane), estimates how much of their wording they share (standard error about 0.09),
which gives `likeness`, from 0 to 1. Stored sums can be added and subtracted (`Fingerprints`); where only equality and likeness
are asked for, as in the query, the first part is given as its BLAKE2b-256 digest (`digests`).

Null texts count as empty; an empty text has one empty paragraph. Equal texts have equal fingerprints, and so have texts of
the same paragraphs in another order. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textkernel as K
from folio.llm.common import id_bounds, parallelism, small_batches, table, with_block

U = np.uint64
STRONG, LANES, RUN = 32, 128, 3


class Fingerprints:
    """Vectors of several texts: strong (n x 32, 64 bits) and lanes (n x 128, 32 bits)."""

    def __init__(self, strong: np.ndarray, lanes: np.ndarray):
        self.strong, self.lanes = strong, lanes

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.strong + other.strong, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.strong - other.strong, self.lanes - other.lanes)

    def strings(self) -> list[str]:
        return [base64.b64encode(s.astype("<u8").tobytes() + v.astype("<u4").tobytes()).decode() for s, v in zip(self.strong, self.lanes, strict=True)]

    def digests(self) -> list[str]:
        """A digest of the sums, and the lanes; equal for equal fingerprints."""
        return [base64.b64encode(
            blake2b(s.astype("<u8").tobytes(), digest_size=32).digest() + v.astype("<u4").tobytes()
        ).decode() for s, v in zip(self.strong, self.lanes, strict=True)]

    @staticmethod
    def parse(strings: list[str]) -> Fingerprints:
        raw = [base64.b64decode(x) for x in strings]
        return Fingerprints(
            np.array([np.frombuffer(x, "<u8", STRONG) for x in raw]).reshape(-1, STRONG),
            np.array([np.frombuffer(x, "<u4", LANES, STRONG * 8) for x in raw]).reshape(-1, LANES),
        )


def paragraph_hashes(paragraphs: list[bytes]) -> np.ndarray:
    """n x 32: of each paragraph's BLAKE2b-256, hashed with 0, 1, 2 and 3."""
    counters = [i.to_bytes(1, "little") for i in range(STRONG // 8)]
    firsts = [blake2b(x, digest_size=32).digest() for x in paragraphs]
    return np.frombuffer(b"".join([blake2b(x + c).digest() for x in firsts for c in counters]), "<u8").reshape(-1, STRONG)


def fingerprint(texts: list[bytes]) -> Fingerprints:
    """Fingerprints of whole texts, given as UTF-8."""
    n = len(texts)
    strong = np.zeros((n, STRONG), np.uint64)
    lanes = np.zeros((n, LANES), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    for i, text in enumerate(texts):
        paragraphs = text.split(b"\n")
        for lo in range(0, len(paragraphs), 1 << 14):
            strong[i] += paragraph_hashes(paragraphs[lo : lo + (1 << 14)]).sum(axis=0, dtype=np.uint64)
    for lo, hi in K.blocks(offsets):
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        at = offsets[lo : hi + 1] - offsets[lo]
        paragraphs = np.union1d(at, np.flatnonzero(data == 10) + 1)
        hashes, _, _, places = K.word_hashes(data, paragraphs)
        runs, run_at = K.shingles(hashes, places, RUN)
        owner = np.repeat(np.searchsorted(at, paragraphs[:-1], "right") - 1, np.diff(run_at))
        cell = owner * LANES + (runs >> U(57)).astype(np.int64)
        sign = 1.0 - 2.0 * (runs & U(1)).astype(np.float64)
        lanes[lo:hi] = np.bincount(cell, weights=sign, minlength=(hi - lo) * LANES).reshape(-1, LANES).astype(np.int64)
    return Fingerprints(strong, (lanes & 0xFFFFFFFF).astype(np.uint32))


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """From 0 to 1: 1 for equal fingerprints, else the cosine of the lanes, seen as signed numbers, if it is positive."""
    x, y = a.lanes.astype(np.uint32).view(np.int32).astype(float), b.lanes.astype(np.uint32).view(np.int32).astype(float)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.where(norm > 0, norm, 1.0), 0.0, 1.0)
    return np.where((a.strong == b.strong).all(1) & (a.lanes == b.lanes).all(1), 1.0, cosine)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprint([(x or "").encode() for x in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.strings(), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in sorted runs in which each row's successor by (doc_id, text) follows it.

    Columns: block, copy, doc_id, text. Rows are dealt by ranges of doc_id; the first row of a block is also sent, as a copy,
    to the end of the block before (that of the first block to the last one), so every row meets its successor without a
    window over all rows. One number a block passes the driver (`most` of id_bounds at most)."""
    spark = docs.sparkSession
    small_batches(spark, 250)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = id_bounds(rows.select("doc_id"), per_partition=8)
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    firsts = with_block(rows.select("doc_id"), bounds).select("block", order.alias("first")).groupBy("block").agg(F.min("first").alias("first")).orderBy("block").collect()
    if not firsts:
        return rows.select(F.lit(0).alias("block"), F.lit(0).alias("copy"), "doc_id", "text")
    before = spark.createDataFrame([(r["first"], firsts[i - 1]["block"]) for i, r in enumerate(firsts)], "first long, goes_to int")
    marked = with_block(rows, bounds).join(F.broadcast(before), order == F.col("first"), "left")
    targets = F.when(F.col("goes_to").isNull(), F.array(F.struct(F.col("block"), F.lit(0).alias("copy")))).otherwise(
        F.array(F.struct(F.col("block"), F.lit(0).alias("copy")), F.struct(F.col("goes_to").alias("block"), F.lit(1).alias("copy")))
    )
    dealt = marked.select(F.explode(targets).alias("t"), "doc_id", "text").select("t.block", "t.copy", "doc_id", "text")
    return dealt.repartition(parallelism(spark), "block").sortWithinPartitions("block", "copy", F.col("doc_id").asc_nulls_first(), "text")


def op2_multiset_fingerprint(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    small_batches(spark, 250)

    def judged(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
        own, changed = fingerprint([t.encode() for t in texts]), fingerprint([t.encode() for t in edited])
        last = fingerprint([following[-1].encode()])
        after = Fingerprints(np.vstack([own.strong[1:], last.strong]), np.vstack([own.lanes[1:], last.lanes]))
        return pa.record_batch(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(own.digests()),
                pa.array(changed.digests()),
                pa.array(likeness(own, changed)),
                pa.array(likeness(own, after)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, over, ids, texts = None, False, [], []
        for batch in batches:
            for b, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "copy", "doc_id", "text")), strict=True):
                if b != block:
                    block, over, ids, texts = b, False, [], []
                if over:
                    continue
                if copy:
                    if ids:
                        yield judged(ids, texts, [*texts[1:], text])
                    over, ids, texts = True, [], []
                    continue
                ids.append(doc_id)
                texts.append(text)
            if len(ids) > 1:
                yield judged(ids[:-1], texts[:-1], texts[1:])
                ids, texts = ids[-1:], texts[-1:]

    return with_next(table(spark, sf_dir, "documents")).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
