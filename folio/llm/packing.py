"""Packing: documents, in their order, into sequences of at most `window` ids, by dynamic programming over cut positions.

The ids of consecutive documents (each with an end id) form a stream. It may be cut where a document ends (free), where a
sentence ends (`sentence_penalty`), and, in runs of more than half a window without either, at fixed steps
(`token_penalty`). The windows between cuts hold at most `window` ids and are padded to it, unless their length is a power of
two. Every sequence costs `sequence_penalty`, so that short ones are not made without need. Cuts are chosen to make padding
plus penalties least: with best[j] = penalty[j] + window - p[j] + min(best[i] + p[i])
over the cuts i at most a window before j, the minimum comes from a monotone queue, so each cut enters and leaves it once;
lengths that are powers of two are looked up besides. The stream is cut in blocks of about `block` ids, whose last, open
window is carried into the next block, so memory is bounded and only the end of each input partition is left partly filled.

Null and empty texts are their end id alone. Rows are packed in the order of their input partition, which is the order of
doc_id where the table is written in it; equal or null doc_ids are packed like others. Extra columns are ignored.
sequence_id is unique: the partition's number times 2**32 plus a count.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches, table
from folio.llm.tokens import encoder, vocabulary_path, with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, window: int, sequence_penalty: float = 0.0) -> np.ndarray:
    """The cheapest rising list of positions, from the first to the last, no two neighbours more than window apart."""
    n = len(positions)
    lengths = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    jumps: dict[int, list[int]] = {}
    for length in lengths:
        at = np.searchsorted(positions, positions - length)
        hit = np.flatnonzero((positions - length >= positions[0]) & (positions[np.minimum(at, n - 1)] == positions - length))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            jumps.setdefault(j, []).append(i)
    p, pen = positions.tolist(), penalties.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(p[0] + 0.0, 0)])
    for j in range(1, n):
        here = p[j]
        while p[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        cost = value + window - here
        if j in jumps:
            for k in jumps[j]:
                if best[k] < cost:
                    cost, i = best[k], k
        cost += pen[j] + sequence_penalty
        best[j], back[j] = cost, i
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return positions[cuts[::-1]]


class Ends:
    """Which ids end a sentence, by their written form: the id ends in . ! or ? and the next one starts with white space."""

    def __init__(self, tokenizer, size: int):
        forms = [tokenizer.id_to_token(i) or "" for i in range(size)]
        self.closes = np.array([x.removesuffix("</w>").endswith((".", "!", "?")) or x.endswith("Ċ") for x in forms], bool)
        spaced = any(x.startswith("Ġ") for x in forms)
        self.opens = np.array([not spaced or x.startswith(("Ġ", "Ċ", "ĉ")) for x in forms], bool)

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Positions within ids after which a sentence has ended."""
        ids = np.minimum(ids, len(self.closes) - 1)
        return np.flatnonzero(self.closes[ids[:-1]] & self.opens[ids[1:]]) + 1


_ends: dict[str, Ends] = {}


def cut_places(ends: list[np.ndarray], lengths: list[int], window: int, sentence_penalty: float, token_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream of documents may be cut, and the penalty of each. ends: sentence ends within each document."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    inner = np.concatenate([e + s for e, s in zip(ends, starts[:-1], strict=True)]) if ends else np.empty(0, np.int64)
    positions = np.union1d(starts, inner)
    gaps = np.flatnonzero(np.diff(positions) > window // 2)
    step = window // 8
    extra = [np.arange(positions[g] + step, positions[g + 1], step) for g in gaps]
    added = np.concatenate(extra) if extra else np.empty(0, np.int64)
    every = np.union1d(positions, added)
    penalties = np.full(len(every), float(sentence_penalty))
    penalties[np.searchsorted(every, added)] = token_penalty
    penalties[np.searchsorted(every, starts)] = 0.0
    return every.astype(np.int64), penalties


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 1,
    window: int = 2048,
    sentence_penalty: float = 4.0,
    token_penalty: float = 64.0,
    sequence_penalty: float = 48.0,
    block: int = 1 << 19,
) -> DataFrame:
    """The pieces of all rows of docs (doc_id, text), as SCHEMA. vocabulary: a path that every worker can open."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or vocabulary_path("byte_bpe_50k.json")
        coder = encoder(path)
        if path not in _ends:
            _ends[path] = Ends(coder.tokenizer, coder.vocabulary_size)
        marks = _ends[path]
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (doc_id, ids as bytes, ids before them in the document, ids of the document, sentence ends)
        waiting = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, waiting, sequence
            lengths = [len(x[1]) // 4 for x in held]
            positions, penalties = cut_places([x[4] for x in held], lengths, window, sentence_penalty, token_penalty)
            cuts = choose_cuts(positions, penalties, window, sequence_penalty).tolist()
            if not last and len(cuts) > 2:
                cuts.pop()
            out, keep, at, k = [], [], 0, 0
            for (doc_id, ids, before, total, inner), length in zip(held, lengths, strict=True):
                lo = at
                while k < len(cuts) - 1 and lo < at + length:
                    hi = min(at + length, cuts[k + 1])
                    out.append((doc_id, before + lo - at, hi - lo, zlib.crc32(ids[4 * (lo - at) : 4 * (hi - at)]), total, sequence, lo - cuts[k]))
                    lo = hi
                    if lo == cuts[k + 1]:
                        k += 1
                        sequence += 1
                if lo < at + length:
                    done = lo - at
                    keep.append((doc_id, ids[4 * done :], before + done, total, inner[inner > done] - done))
                at += length
            held, waiting = keep, sum(len(x[1]) // 4 for x in keep)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

        for batch in batches:
            flat, at = with_end(*coder.encode_batch(batch.column(1)), end_id)
            ends, raw = marks.after(flat), memoryview(flat.astype("<u4").tobytes())
            inside = np.searchsorted(ends, at)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                own = ends[inside[i] : inside[i + 1]] - a
                held.append((doc_id, bytes(raw[4 * a : 4 * b]), 0, b - a, own[own > 0]))
                waiting += b - a
                if waiting >= block:
                    yield flush(False)
        if held:
            yield flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op10_pack_documents(spark, sf_dir: str) -> DataFrame:
    """documents -> the pieces of all documents, in sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
