"""LM scoring with a log-frequency Bloom filter.

Counts of all words and word pairs of the training rows, however rare, are quantised: level 1 + floor(log_base(count)). For an
n-gram of level q the filter holds the q items (n-gram, 1) ... (n-gram, q); a reader probes level after level until one is
missing. Its size follows the number of items, 10 bits each. It is built in segments, to which n-grams are dealt by hash; a
task counts and builds its segments at once, and tasks are as many as the text's bytes ask for, so that none grows. Segments
are a written table, and are broadcast in groups of at most `most_bytes`: where all fit in one group, texts are scored in one
pass; else every pass fills in the levels of the tokens whose n-grams are in its group, and the last ones give the scores.
Results don't depend on the number of groups, and nothing is left out.

score is the log10 probability of a text under Dirichlet-smoothed pairs,
p(w|v) = (c(v,w) + strength p(w)) / (c(v) + strength) with p(w) = (c(w) + 1) / (N + V + 1),
so what a context lacks in counts goes to the words' own probabilities. Pairs and words count with the least of their level,
contexts with the greatest, and a pair never more than its context; thus every p is below 1, and over all words p sums to at
most 1 (a false positive of the filter, about one in a hundred probes, adds a count of 1; see the README for measured sums). A text
starts after a start mark, which occurs as often as the end, and ends with an end token. base_score is the add-one unigram score
with exact counts: the most frequent words (at most `head` of them) are looked up in a broadcast table, the other words' counts
are joined by hash, and the sums are gathered per row.

Null and empty texts have one token, the end. Rows with null doc_id are not learned from and are scored. Repeated rows are
scored alike. With nothing to learn from all counts are 0. Extra columns are ignored. Words are compared by 63-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textkernel as K
from folio.llm.common import parallelism, small_batches, table, written

U = np.uint64
#: The lowest bit of a hash tells pairs (1) from words (0).
END, START = U(0xE5D00D5EED000002), U(0x57A2700000000004)
PROBES, ITEM_BITS = 5, 10


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words with an end token after them, and the n+1 positions."""
    hashes, _, _, at = K.word_hashes(data, offsets, lower=True)
    out_at = at + np.arange(len(at))
    out = np.full(out_at[-1], END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = hashes & ~U(1)
    return out, out_at


def before(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each, the start mark for a text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[at[:-1]] = START
    return out


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return K.mix(first * U(K.BASE) + second) | U(1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def ngram_counts(docs: DataFrame, held: int = 2_000_000) -> DataFrame:
    """(gram, count) of all words and pairs of docs (text), summed within tasks as far as `held` n-grams reach."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            grams, counts = _merged(waiting)
            waiting.clear()
            return pa.record_batch([pa.array(grams.view(np.int64)), pa.array(counts)], names=["gram", "count"])

        for batch in batches:
            data, offsets = K.views(batch.column("text"))
            for lo, hi in K.blocks(offsets, 1 << 20):
                tokens, at = token_stream(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                waiting += [np.unique(tokens, return_counts=True), np.unique(pair_hash(before(tokens, at), tokens), return_counts=True)]
                if sum(len(x[0]) for x in waiting) >= held:
                    yield emit()
        if waiting:
            yield emit()

    return docs.select("text").mapInArrow(run, "gram long, count long")


@dataclass
class Levels:
    """How counts are quantised."""

    base: float

    def of(self, counts: np.ndarray) -> np.ndarray:
        """1 + floor(log_base(count)); the small shift keeps exact powers on their level."""
        return (np.floor(np.log(counts) / math.log(self.base) + 1e-9) + 1).astype(np.int64)

    def least(self, levels: np.ndarray) -> np.ndarray:
        """The least count of each level, 0 for level 0."""
        return np.where(levels > 0, np.ceil(self.base ** (levels - 1.0) - 1e-9), 0.0)

    def greatest(self, levels: np.ndarray) -> np.ndarray:
        return np.where(levels > 0, np.maximum(np.ceil(self.base ** (levels * 1.0) - 1e-6) - 1, self.least(levels)), 0.0)


@dataclass
class LogFilter:
    """Some of the segments of a filter: start is where each begins in data, in bytes, -1 if it isn't here; bits its size."""

    start: np.ndarray
    bits: np.ndarray
    data: np.ndarray

    @staticmethod
    def of(n: int, parts: dict[int, bytes | np.ndarray]) -> LogFilter:
        start, bits, at = np.full(n, -1, np.int64), np.ones(n, np.int64), 0
        for segment, raw in parts.items():
            start[segment], bits[segment], at = at, 8 * len(raw), at + len(raw)
        return LogFilter(start, bits, np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in parts.values())]))

    def segment(self, grams: np.ndarray) -> np.ndarray:
        return ((grams >> U(1)) % U(len(self.start))).astype(np.int64)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        """Whether each n-gram's segment is here."""
        return self.start[self.segment(grams)] >= 0

    def _places(self, grams: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Byte places and masks of the probes of one level, one after another."""
        segment = self.segment(grams)
        start, bits = self.start[segment], self.bits[segment].astype(np.uint64)
        state = K.mix(grams + U((level * 0xD1B54A32D192ED03) & (2**64 - 1)))
        one, two = state >> U(32), (state & U(0xFFFFFFFF)) | U(1)
        for k in range(PROBES):
            bit = (((one + U(k) * two) & U(0xFFFFFFFF)) * bits) >> U(32)
            yield start + (bit >> U(3)).astype(np.int64), np.left_shift(1, (bit & U(7)).astype(np.uint8), dtype=np.uint8)

    def insert(self, grams: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            grams, levels = grams[levels >= level], levels[levels >= level]
            for place, mask in self._places(grams, level):
                np.bitwise_or.at(self.data, place, mask)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """By probing level 1, 2, ... until an item is missing; all segments asked for must be here."""
        out = np.zeros(len(grams), np.uint8)
        alive, now, level = np.arange(len(grams)), grams, 1
        while len(alive):
            held = np.ones(len(now), bool)
            left = np.arange(len(now))
            for place, mask in self._places(now, level):
                hit = (self.data[place[left]] & mask[left]) != 0
                held[left[~hit]] = False
                left = left[hit]
                if not len(left):
                    break
            alive, now = alive[held], now[held]
            out[alive] = level
            level += 1
        return out


def built(grams: np.ndarray, levels: np.ndarray, n_segments: int) -> dict[int, np.ndarray]:
    """The segments that these n-grams fall into, complete."""
    segment = LogFilter.of(n_segments, {}).segment(grams)
    items = np.bincount(segment, weights=levels, minlength=n_segments)
    sizes = {int(s): np.zeros(max(8, math.ceil(items[s] * ITEM_BITS / 64) * 8), np.uint8) for s in np.unique(segment)}
    whole = LogFilter.of(n_segments, sizes)
    whole.insert(grams, levels)
    return {s: whole.data[whole.start[s] : whole.start[s] + len(x)] for s, x in sizes.items()}


@dataclass
class Model:
    words: int  # N
    distinct: int  # V
    levels: Levels
    n_segments: int
    head: tuple[np.ndarray, np.ndarray]  # hashes, ascending, and exact counts
    whole_head: bool  # no word is missing from head
    groups: list[dict[int, int]]  # segments that are broadcast together, ascending, and their sizes
    table: DataFrame | None = None  # segment, data, and gram, count of words

    def filter(self, group: dict[int, int]) -> LogFilter:
        """The group's segments, fetched a file at a time, so that the driver holds them once."""
        start, bits, at = np.full(self.n_segments, -1, np.int64), np.ones(self.n_segments, np.int64), 0
        for segment, size in group.items():
            start[segment], bits[segment], at = at, 8 * size, at + size
        data = np.empty(at, np.uint8)
        if group:
            rows = self.table.where(F.col("segment").between(min(group), max(group)) & F.col("data").isNotNull()).select("segment", "data")
            for r in rows.toLocalIterator(prefetchPartitions=True):
                data[start[r["segment"]] : start[r["segment"]] + len(r["data"])] = np.frombuffer(r["data"], np.uint8)
        return LogFilter(start, bits, data)


def fit(docs: DataFrame, base: float = 1.5, most_bytes: int = 192 << 20, head: int = 1 << 19, task_bytes: int = 32 << 20) -> Model:
    """A model of the rows of docs (text): at most most_bytes of filter and 16 * head bytes of table are broadcast at once; a
    task counts the n-grams of about task_bytes of text."""
    spark = docs.sparkSession
    levels = Levels(base)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(parallelism(spark), -(-total // task_bytes))
    n_segments = 16 * tasks

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("gram"), np.int64).view(np.uint64), np.asarray(b.column("count"), np.int64)) for b in batches]
        if not parts:
            return
        grams, counts = _merged(parts)
        del parts
        for segment, data in built(grams, levels.of(counts), n_segments).items():
            yield pa.record_batch(
                [pa.array([segment], pa.int32()), pa.array([data.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())],
                names=["segment", "data", "gram", "count"],
            )
        word = grams & U(1) == 0
        n = int(word.sum())
        yield pa.record_batch(
            [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(grams[word].view(np.int64)), pa.array(counts[word])],
            names=["segment", "data", "gram", "count"],
        )

    rows = ngram_counts(docs)
    segment = F.pmod(F.shiftrightunsigned("gram", 1), F.lit(n_segments))
    dealt = rows.repartition(tasks, segment)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    made = written(dealt.mapInArrow(build, "segment int, data binary, gram long, count long"), "ngrams")

    sizes = made.where("data is not null").select("segment", F.length("data").alias("n")).orderBy("segment").collect()  # one number a segment
    groups: list[dict[int, int]] = []
    room = 0
    for r in sizes:
        if not groups or room < r["n"]:
            groups.append({})
            room = most_bytes
        groups[-1][r["segment"]] = r["n"]
        room -= r["n"]
    words = made.where("data is null").select("gram", "count")
    by_level = words.groupBy(F.floor(F.log2("count")).alias("level")).agg(F.count("*").alias("grams"), F.sum("count").alias("total")).collect()  # at most 64 rows
    many, least = 0, 64
    for r in sorted(by_level, key=lambda r: -r["level"]):
        if many + r["grams"] > head:
            break
        many, least = many + r["grams"], r["level"]
    top = words.where(F.floor(F.log2("count")) >= least).toArrow() if many else None
    grams = np.asarray(top["gram"], np.int64).view(np.uint64) if many else np.empty(0, np.uint64)
    order = np.argsort(grams)
    exact = np.asarray(top["count"], np.int64)[order] if many else np.empty(0, np.int64)
    n, distinct = sum(r["total"] for r in by_level), sum(r["grams"] for r in by_level)
    return Model(n, distinct, levels, n_segments, (grams[order], exact), many == distinct, groups, made)


def look_up(part: LogFilter, tokens: np.ndarray, at: np.ndarray, out: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Levels of each token and of its pair with the one before, filled in where their segments are here."""
    words, pairs = out or (np.zeros(len(tokens), np.uint8), np.zeros(len(tokens), np.uint8))
    for target, grams in ((words, tokens), (pairs, pair_hash(before(tokens, at), tokens))):
        found, where = np.unique(grams, return_inverse=True)
        here = part.holds(found)
        level = np.zeros(len(found), np.uint8)
        level[here] = part.levels(found[here])
        np.maximum(target, level[where], out=target)
    return words, pairs


def text_scores(model: Model, words: np.ndarray, pairs: np.ndarray, at: np.ndarray, ends: int, strength: float) -> np.ndarray:
    """log10 probabilities of the texts from their tokens' levels; ends is the level of the end token."""
    context = np.empty(len(words), np.uint8)
    context[1:] = words[:-1]
    context[at[:-1]] = ends
    up = model.levels.greatest(context.astype(np.int64))
    both = np.minimum(model.levels.least(pairs.astype(np.int64)), up)
    own = (model.levels.least(words.astype(np.int64)) + 1) / (model.words + model.distinct + 1)
    return np.add.reduceat(np.log10((both + strength * own) / (up + strength)), at[:-1])


STATE = "row long, tokens binary, at binary, words binary, pairs binary"


def _levels_by_groups(state: DataFrame, model: Model) -> DataFrame:
    """STATE with all levels filled in: one pass a group of segments, each a written table that replaces the one before."""
    spark = state.sparkSession
    for group in model.groups:
        shared = spark.sparkContext.broadcast(model.filter(group))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words_out, pairs_out = [], []
                for tokens, at, words, pairs in zip(*(batch.column(c).to_pylist() for c in ("tokens", "at", "words", "pairs")), strict=True):
                    old = tuple(np.frombuffer(x, np.uint8).copy() for x in (words, pairs))
                    words, pairs = look_up(shared.value, np.frombuffer(tokens, np.uint64), np.frombuffer(at, np.int64), old)
                    words_out.append(words.tobytes())
                    pairs_out.append(pairs.tobytes())
                yield pa.record_batch(
                    [batch.column("row"), batch.column("tokens"), batch.column("at"), pa.array(words_out, pa.binary()), pa.array(pairs_out, pa.binary())],
                    names=["row", "tokens", "at", "words", "pairs"],
                )

        state = written(state.mapInArrow(run, STATE), "levels")
    return state


def scores(docs: DataFrame, model: Model, strength: float = 256.0) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    one_pass = len(model.groups) <= 1
    part = model.filter(model.groups[0]) if one_pass and model.groups else LogFilter.of(model.n_segments, {})
    light = Model(model.words, model.distinct, model.levels, model.n_segments, model.head, model.whole_head, model.groups)
    shared = spark.sparkContext.broadcast((light, part))
    below = math.log10(model.words + model.distinct + 1)
    end_group = next((g for g in model.groups if int((END >> U(1)) % U(model.n_segments)) in g), {})
    ends = int((part if one_pass else model.filter(end_group)).levels(np.array([END]))[0]) if model.groups else 0

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
        """Row numbers, doc_ids, tokens and positions of runs of texts; a row's number is the same in every run of a task."""
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = K.views(batch.column("text"))
            for lo, hi in K.blocks(offsets, 1 << 20):
                tokens, at = token_stream(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield row + np.arange(hi - lo), batch.column("doc_id").slice(lo, hi - lo).to_pylist(), tokens, at
                row += hi - lo

    def judged(rows: np.ndarray, doc_ids: list, tokens: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """A row a text with what the head settles, and one for each other word of each text, to meet its count."""
        model, part = shared.value
        known, exact = model.head
        n = len(rows)
        owner = np.repeat(np.arange(n), np.diff(at))
        place = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
        in_head = known[place] == tokens if len(known) else np.zeros(len(tokens), bool)
        count = np.where(in_head, exact[place], 0) if len(known) else np.zeros(len(tokens), np.int64)
        settled = in_head | model.whole_head
        base = np.bincount(owner[settled], weights=np.log10(count[settled] + 1.0), minlength=n) - below * np.diff(at)
        n_known = np.bincount(owner[settled], weights=count[settled] > 0, minlength=n).astype(np.int64)
        o, t = owner[~settled], tokens[~settled]
        order = np.lexsort((t, o))
        o, t = o[order], t[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(o)))
        score = text_scores(model, *look_up(part, tokens, at), at, ends, strength) if one_pass else np.zeros(n)
        tail, none = np.zeros(len(first), np.int64), np.zeros(n, np.int64)
        both = lambda a, b: pa.array(np.concatenate([a, b]))
        columns = {
            "row": both(rows, rows[o[first]]), "gram": both(
                K.mix(rows.astype(np.uint64)).view(np.int64), t[first].view(np.int64),
            ), "is_word": both(none.astype(np.int32), tail.astype(np.int32) + 1), "times": both(none, times),
            "doc_id": pa.array([*doc_ids, *[None] * len(first)], pa.int64()), "n_tokens": both(np.diff(at), tail), "n_known": both(n_known, tail), "base": both(base, tail * 1.0), "score": both(score, tail * 1.0),
        }
        return pa.record_batch(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in tokenised(batches):
            yield judged(*x)

    kind = "row long, gram long, is_word int, times long, doc_id long, n_tokens long, n_known long, base double, score double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if one_pass:
        rows = texts.mapInArrow(run, kind)
        if model.whole_head:
            return rows.select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")
    else:
        # the tokens are written once, so that all passes and the base scores speak of the same row numbers
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, doc_ids, tokens, at in tokenised(batches):
                zero = bytes(len(tokens))
                yield pa.record_batch(
                    [
                        pa.array(rows[:1]),
                        pa.array([tokens.tobytes()], pa.binary()),
                        pa.array([at.tobytes()], pa.binary()),
                        pa.array([zero], pa.binary()),
                        pa.array([zero], pa.binary()),
                        pa.array([doc_ids], pa.list_(pa.int64())),
                    ],
                    names=["row", "tokens", "at", "words", "pairs", "doc_ids"],
                )

        stream = written(texts.mapInArrow(split, STATE + ", doc_ids array<long>"), "tokens")

        def based(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield judged(r["row"] + np.arange(len(r["doc_ids"])), r["doc_ids"], np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["at"], np.int64))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    at = np.frombuffer(r["at"], np.int64)
                    found = text_scores(shared.value[0], np.frombuffer(r["words"], np.uint8), np.frombuffer(r["pairs"], np.uint8), at, ends, strength)
                    yield pa.record_batch([pa.array(r["row"] + np.arange(len(found))), pa.array(found)], names=["row", "score"])

        levels = _levels_by_groups(stream.drop("doc_ids"), model).mapInArrow(scored, "row long, score double")
        rest = {
            "gram": F.col("row"),
            "is_word": F.lit(0),
            "times": F.lit(0).cast("long"),
            "doc_id": F.lit(None).cast("long"),
            "n_tokens": F.lit(0).cast("long"),
            "n_known": F.lit(0).cast("long"),
            "base": F.lit(0.0),
        }
        rows = stream.mapInArrow(based, kind).unionByName(levels.withColumns(rest))
    counts = model.table.where("data is null").select(F.col("gram").alias("g"), F.lit(1).alias("w"), "count")
    joined = rows.join(counts, (F.col("gram") == F.col("g")) & (F.col("is_word") == F.col("w")), "left")
    added = F.when(F.col("count").isNotNull(), F.col("times") * F.log10(F.col("count") + F.lit(1.0))).otherwise(0.0)
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), (
            F.sum("n_known") + F.sum(F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0))
        ).alias("n_known"), F.sum(F.col("base") + added).alias("base_score"), F.sum("score").alias("score")
    )
    return summed.drop("row")


def op8_bloom_lm(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    model = fit(docs.where(fold != 2))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.words).cast("long").alias("train_tokens"), "base_score", "score",
    )
