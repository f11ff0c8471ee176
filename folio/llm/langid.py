"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text's features are its letters' byte 3-grams and 4-grams and its whole words, hashed; ASCII that is not a letter counts as
space. The model is the mean of the features' embeddings times a matrix; as both are linear, prediction needs only the product
table (a row of class scores for each of 2**bits hashes). Training: a bounded sample, `per_language` rows of each language (at
most `most_rows` together, of each at most `most_features` distinct features) picked by a hash of doc_id, a part of which is
held back for calibration. Prediction reads every whole text, long ones in parts; what is broadcast are the product table, one
number a hash and language (at most `most_languages`, more raise an error), and one bit of 2**known_bits hashes.

Calibration fits a temperature by the likelihood of targets smoothed by one row a class, which has its best value inside the
grid even if no row is mistaken. Texts are rejected for one of two reasons. One is a low score. The other is that too few of
their features are known, that is, occur in training texts of any language: the share that decides lies halfway between what
nearly all held-back texts of learned languages reach, and what those of a language reach by the features of the others
(leave one language out). A short text's share counts as two standard errors higher, so that few features alone reject nothing.

Null texts and texts without a letter: `und` with score 0, rejected. Rows with a null lang or null doc_id aren't learned
from. Nothing learnable at all: every text is `und`. Repeated rows are predicted alike, ties go to the language that sorts
first, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import textkernel as K
from folio.llm.common import small_batches, table

U = np.uint64
#: Bytes as features see them: lower-case letters and bytes of other alphabets stay, the rest is a space.
SHOWN = np.full(256, 32, np.uint8)
SHOWN[97:123] = np.arange(97, 123)
SHOWN[65:91] = np.arange(97, 123)
SHOWN[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # 2**bits x languages
    bits: int
    known: np.ndarray  # packed bits, one for each of 2**known_bits hashes
    known_bits: int
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0


def have_letters(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter. Only texts without ASCII letters are looked at character by character."""
    ascii_ = np.concatenate([[0], np.cumsum(SHOWN[data] - np.uint8(97) < 26, dtype=np.int64)])
    out = np.diff(ascii_[offsets]) > 0
    wide = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
    for i in np.flatnonzero(~out & (np.diff(wide[offsets]) > 0)).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts and their n+1 positions. Each text is seen with a space at either end."""
    n = len(offsets) - 1
    shown = np.full(len(data) + n + 1, 32, np.uint8)
    if len(data):
        shown[np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))] = SHOWN[data]
    at = offsets + np.arange(n + 1)
    b = shown.astype(np.uint64)
    space = shown == 32
    three = b[:-2] | (b[1:-1] << U(8)) | (b[2:] << U(16))
    four = three[:-1] | (b[3:] << U(24)) | U(1 << 40)
    shift = U(64 - bits)
    # a gram counts if its middle holds no space, so that it lies in one word with at most the spaces around it
    ok3, ok4 = np.flatnonzero(~space[1:-1]), np.flatnonzero(~space[1:-2] & ~space[2:-1])
    starts, ends, _ = K.words(shown, at)
    whole = K.span_hashes(shown, starts, ends)
    place = np.concatenate([ok3 + 1, ok4 + 1, starts])
    found = np.concatenate([(three[ok3] * U(K.BASE)) >> shift, (four[ok4] * U(K.BASE)) >> shift, whole >> shift]).astype(np.int64)
    owner = np.searchsorted(at, place, "right") - 1
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(n + 1))


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows between consecutive positions; empty runs are 0."""
    out = np.zeros((len(at) - 1, values.shape[1]))
    has = np.flatnonzero(np.diff(at) > 0)
    if len(has):
        out[has] = np.add.reduceat(values, at[:-1][has], axis=0)
    return out


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    languages: list[str],
    bits: int,
    known_bits: int,
    dims: int = 16,
    epochs: int = 4,
    rate: float = 4.0,
    batch: int = 32,
    seed: int = 7,
) -> Model:
    """rows: (distinct features of known_bits bits, counts, class)."""
    known = np.zeros(1 << known_bits, bool)
    for x in rows:
        known[x[0]] = True
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / dims, 1 / dims, (1 << bits, dims))
    top = rng.uniform(-1 / dims, 1 / dims, (dims, len(languages)))
    steps, done = epochs * ((len(rows) + batch - 1) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = [rows[i] for i in order[lo : lo + batch]]
            at = np.concatenate([[0], np.cumsum([len(x[0]) for x in part])])
            ids = np.concatenate([x[0] for x in part]) >> (known_bits - bits)
            share = np.concatenate([x[1] / x[1].sum() for x in part])
            hidden = segment_sums(table_[ids] * share[:, None], at)
            logits = hidden @ top
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [x[2] for x in part]] -= 1
            now = rate * (1 - done / steps)
            back = p @ top.T
            top -= now * hidden.T @ p
            np.add.at(table_, ids, -now * np.repeat(back, np.diff(at), axis=0) * share[:, None])
            done += 1
    return Model(languages, (table_ @ top).astype(np.float32), bits, np.packbits(known), known_bits)


def is_known(model: Model, ids: np.ndarray) -> np.ndarray:
    return (model.known[ids >> 3] >> (7 - (ids & 7)).astype(np.uint8)) & np.uint8(1)


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray, part: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its logits, the share of its features that are known, and their number. At most about part bytes are
    looked at together."""
    n = len(offsets) - 1
    logits, known, many = np.zeros((n, len(model.languages))), np.zeros(n), np.zeros(n)
    fine, owner = K.split_long(data, offsets, part, within=1 << 12)
    for lo, hi in K.blocks(fine, part):
        ids, at = features(data[fine[lo] : fine[hi]], fine[lo : hi + 1] - fine[lo], model.known_bits)
        np.add.at(logits, owner[lo:hi], segment_sums(model.scores[ids >> (model.known_bits - model.bits)], at))
        np.add.at(known, owner[lo:hi], segment_sums(is_known(model, ids)[:, None].astype(np.float64), at)[:, 0])
        np.add.at(many, owner[lo:hi], np.diff(at))
    return logits / np.maximum(many, 1)[:, None], known / np.maximum(many, 1), many


def lenient(share: np.ndarray, many: np.ndarray, errors: float = 2.0) -> np.ndarray:
    """A share of known features and some standard errors (of a share that counts one more known and one more unknown feature)."""
    p = (share * many + 1) / (many + 2)
    return share + errors * np.sqrt(p * (1 - p) / np.maximum(many, 1))


def probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    scaled = logits / temperature
    p = np.exp(scaled - scaled.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """By likelihood, where a row's class has the weight (n + 1) / (n + classes) and the others share the rest."""
    n, classes = logits.shape
    target = np.full((n, classes), 1.0 / (n + classes))
    target[np.arange(n), truth] = (n + 1.0) / (n + classes)
    target /= target.sum(1, keepdims=True)
    grid = np.geomspace(1e-3, 100, 200)
    losses = [-(target * np.log(np.maximum(probabilities(logits, t), 1e-300))).sum() for t in grid]
    return float(grid[int(np.argmin(losses))])


def calibrate(
    model: Model,
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    learned: list[tuple[np.ndarray, np.ndarray, int]],
    reject_share: float,
    most_least: float = 0.4,
) -> Model:
    """Fits temperature, the score and the share of known features from rows that were held back; learned: the training rows."""
    if not rows:
        return model
    shift = model.known_bits - model.bits
    logits = np.stack([(model.scores[f >> shift] * (c / c.sum())[:, None]).sum(0) for f, c, _ in rows])
    truth = np.array([x[2] for x in rows])
    model.temperature = fit_temperature(logits, truth)
    # a text in two of the languages stays: a score near one half is none to reject
    model.least_score = float(min(most_least, np.quantile(probabilities(logits, model.temperature).max(1), reject_share)))
    many = np.array([c.sum() for _, c, _ in rows])
    inside = np.array([(is_known(model, f) * c).sum() for f, c, _ in rows]) / many
    low = float(np.quantile(lenient(inside, many), reject_share))
    outside = []
    for k in range(len(model.languages)):
        known = np.zeros(1 << model.known_bits, bool)
        for f, _, y in learned:
            if y != k:
                known[f] = True
        outside += [lenient((known[f] * c).sum() / c.sum(), c.sum()) for f, c, y in rows if y == k]
    middle = float(np.median(outside)) if len(model.languages) > 1 and outside else 2 * low - 1
    model.least_known = max(0.0, min(low, (low + middle) / 2))
    return model


def sample_features(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """(lang, part, ids, counts) of the rows (doc_id, text, lang, part): distinct features; of more than most, those of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.views(batch.column("text"))
            parts: list[list] = [[] for _ in range(batch.num_rows)]
            fine, owner = K.split_long(data, offsets, 1 << 19, within=1 << 12)
            for lo, hi in K.blocks(fine, 1 << 19):
                found, at = features(data[fine[lo] : fine[hi]], fine[lo : hi + 1] - fine[lo], bits)
                for i in range(hi - lo):
                    parts[owner[lo + i]].append(np.unique(found[at[i] : at[i + 1]], return_counts=True))
            ids, counts = [], []
            for own in parts:
                distinct, where = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
                many = np.bincount(where, weights=np.concatenate([x[1] for x in own]), minlength=len(distinct))
                if len(distinct) > most:
                    pick = np.sort(np.argsort(K.mix(distinct.astype(np.uint64) + U(1)))[:most])
                    distinct, many = distinct[pick], many[pick]
                ids.append(distinct.astype(np.int32).tobytes())
                counts.append(many.astype(np.int32).tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("lang"), batch.column("part"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc_id", "lang", "part", "ids", "counts"],
            )

    return rows.select("doc_id", "text", "lang", "part").mapInArrow(run, "doc_id long, lang string, part int, ids binary, counts binary")


def fit(
    labelled: DataFrame,
    per_language: int = 600,
    most_rows: int = 8192,
    most_features: int = 8192,
    calibration: float = 0.3,
    bits: int = 16,
    known_bits: int = 20,
    most_languages: int = 256,
    reject_share: float = 0.001,
    **how,
) -> Model | None:
    """A model from (doc_id, text, lang): at most about per_language rows of each language and most_rows in all reach the driver,
    as at most most_features distinct features each."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages")
    languages = sorted(counts)
    per_language = max(1, min(per_language, most_rows // len(languages)))
    draw = (F.xxhash64(F.lit("sample"), "doc_id") / F.lit(float(1 << 63)) + 1) / 2
    picked = F.lit(False)
    for lang in languages:
        picked = picked | ((F.col("lang") == lang) & (draw < per_language / counts[lang]))
    part = F.when((F.xxhash64(F.lit("part"), "doc_id") / F.lit(float(1 << 63)) + 1) / 2 < calibration, 1).otherwise(0)
    # as Arrow batches: rows of Python objects would take many times their bytes in the driver's heap
    got = sample_features(rows.where(picked).withColumn("part", part), known_bits, most_features).limit(2 * per_language * len(languages)).toArrow()
    parts: tuple[list, list] = ([], [])
    for _, ids, counts_, lang, k in sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "ids", "counts", "lang", "part")), strict=True)):
        if ids:
            # as they came, without a wider copy: the driver holds all of the sample
            parts[k].append((np.frombuffer(ids, np.int32), np.frombuffer(counts_, np.int32), languages.index(lang)))
    del got
    if not parts[0]:
        return None
    return calibrate(train(parts[0], languages, bits, known_bits, **how), parts[1], parts[0], reject_share)


def judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its class (one past the languages: none), score, and whether it is rejected."""
    n = len(texts)
    data, offsets = K.views(texts)
    none = len(model.languages) if model else 0
    if model is None or not n:
        return np.full(n, none), np.zeros(n), np.ones(n, bool)
    logits, share, many = evidence(model, data, offsets)
    p = probabilities(logits, model.temperature)
    best, score = p.argmax(1), p.max(1)
    rejected = (score < model.least_score) | (lenient(share, many) < model.least_known)
    silent = ~have_letters(texts, data, offsets)
    best[silent], score[silent], rejected[silent] = none, 0.0, True
    return best, score, rejected


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(shared.value.languages if shared.value else []), "und"], object)
        for batch in batches:
            best, score, rejected = judge(shared.value, batch.column("text"))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score, rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(3) != 1))
    return predict(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows whose language is rejected; rows without doc_id are judged by their text as well."""
    model = fit(docs.select("doc_id", "text", "lang").where(fold(3) != 1), **how)
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~judge(shared.value, batch.column("text"))[2]))

    return docs.mapInArrow(run, docs.schema)
