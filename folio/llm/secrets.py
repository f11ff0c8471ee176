"""Secret scans: candidate strings, and a random forest that removes the false positives. DataFrame functions throughout.

A candidate is a run of 16 or more of [A-Za-z0-9_+/-] with a digit in it, or the value (6 or more characters) assigned to a
name such as password, token, secret or key, with or without blanks around = or :. A word may hold any number of them, and all
are judged, keys in issuers' formats inside longer runs too; equal ones in a word are one candidate. Its features: length, shares of digits, upper case and hexadecimal digits,
distinct characters, changes between character classes and between vowels and consonants, the share of its letters that lie
in dictionary words (letter runs of 4 or more that the whole corpus has in at least `least_count` places), whether it looks
like a path or address, and whether the words before it name a credential or assign it.

The forest (Spark ML, 20 trees) learns from labelled findings: pass your own, or let `rule_labels` mark the clear cases -
issuers' formats and random-looking values assigned to credential names against numbers, addresses and prose. At most about
`sample_rows` labelled findings, picked by a hash, are learned from; every candidate is judged. With fewer than two classes
of labels there is nothing to learn and the labels themselves decide.

Null or empty texts have no candidates. Repeated rows are judged alike; a null doc_id is kept as it is; extra columns are
ignored by `findings` and kept by `redacted`.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import table, written

SPLIT = r"[\x20\x09-\x0D]+"
#: Names whose value is a credential, as patterns over lower-case text.
NAMES = r"pass|pwd|token|secret|api|key|auth|credential"
NAME = r"(?:pass|pwd|token|secret|key|auth|credential)[a-z_]*"
#: A value ends at &, ; or , only where another name and sign follow.
VALUE = r"((?:[^\s\"'=:&;,]|[&;,](?![\w.-]+[\"']?[=:])){6,})"
ASSIGNED = rf"(?i){NAME}[\"']?[=:][\"']?{VALUE}"
#: A value whose name, or name and sign, are the words before it.
NAME_BEFORE = rf"(?i){NAME}[\"']?(?:[=:]| [=:])[\"']?$"
NAME_ALONE = rf"(?i){NAME}[\"']?$"
FIRST_VALUE = rf"^[\"']?{VALUE}"
SIGN_VALUE = rf"^[=:][\"']?{VALUE}"
RUN = r"([A-Za-z0-9_+/-]{16,})"
#: Published formats of issuers' keys (fixed values).
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$"
ISSUED_INSIDE = r"((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
FEATURES = ["f_length", "f_digits", "f_upper", "f_hex", "f_distinct", "f_turns", "f_vowel_turns", "f_dictionary", "f_path", "f_named", "f_assigned", "f_quoted"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, place, value, before, word): one row a candidate; place counts words from 0."""
    words = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), F.split("text", SPLIT).alias("words"))

    i = F.col("place")
    at = lambda k: F.get("words", i - k)
    # cheap tests choose the words, and only their values are extracted
    alone = F.lit(r"(?i)(?:pass|pwd|token|secret|key|auth|credential)")

    def is_candidate(w: Column, k: Column) -> Column:
        last, earlier = F.get("words", k - 1), F.get("words", k - 2)
        run = (F.length(w) >= 16) & F.regexp_like(w, F.lit("[0-9]")) & w.rlike(RUN)
        named_before = (F.length(w) >= 6) & F.coalesce(last.rlike(r"[=:][\"']?$"), F.lit(False)) & (
            F.regexp_like(last, alone) | F.coalesce(F.regexp_like(earlier, alone), F.lit(False))
        )
        return run | ((F.length(w) >= 10) & w.rlike(ASSIGNED)) | ((F.length(w) >= 15) & w.rlike(ISSUED_INSIDE)) | named_before | (
            w.rlike("^[=:]") & F.coalesce(F.regexp_like(last, alone), F.lit(False))
        )

    places = F.filter(F.transform("words", lambda w, k: F.when(is_candidate(w, k), k)), lambda k: k.isNotNull())
    found = words.where("words is not null").select("doc_id", "text_key", "words", F.explode(places).alias("place"))
    before = F.concat_ws(" ", F.when(i >= 2, at(2)), F.when(i >= 1, at(1)))
    found = found.select("doc_id", "text_key", "place", at(0).alias("word"), before.alias("before"), F.when(i >= 1, at(1)).alias("last"))
    some = lambda test, pattern: F.when(test, F.regexp_extract_all("word", F.lit(pattern), 1)).otherwise(F.array().cast("array<string>"))
    assigned = F.array_union(
        F.array_union(some(F.lit(True), ASSIGNED), some(F.col("before").rlike(NAME_BEFORE), FIRST_VALUE)), some(F.col("last").rlike(NAME_ALONE), SIGN_VALUE),
    )
    runs = F.filter(F.regexp_extract_all("word", F.lit(RUN), 1), lambda r: r.rlike("[0-9]"))
    valued = found.withColumn("assigned", assigned).withColumn(
        "value", F.explode(F.array_union(F.array_union("assigned", runs), some(F.lit(True), ISSUED_INSIDE))),
    )
    return valued.select("doc_id", "text_key", "place", "word", "before", "value")


def dictionary(docs: DataFrame, least_count: int = 5) -> DataFrame:
    """Lower-case letter runs of 4 or more that all texts together have least_count times. Counts are summed before the shuffle."""
    runs = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("run")).where(F.length("run") >= 4)
    return runs.groupBy("run").count().where(F.col("count") >= least_count).select("run")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with its features. Equal (value, word, before) are described once."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    turns = F.regexp_count(v, F.lit("[A-Za-z](?=[0-9])")) + F.regexp_count(v, F.lit("[0-9](?=[A-Za-z])")) + F.regexp_count(v, F.lit("[a-z](?=[A-Z])"))
    vowel_turns = F.regexp_count(v, F.lit("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"))
    pieces = found.select("value").distinct().select(
        "value", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"(\p{L}{4,})"), 1))).alias("run"),
    )
    covered = pieces.join(known, "run").groupBy(F.col("value").alias("v")).agg(F.sum(F.length("run")).alias("covered"))
    with_cover = found.join(covered, found.value == covered.v, "left")
    around = F.lower(F.concat_ws(" ", "before", F.substring_index("word", "=", 1)))
    return with_cover.select(
        *found.columns,
        n.cast("double").alias("f_length"), share("[0-9]").alias("f_digits"), share("[A-Z]").alias("f_upper"), share("[0-9a-fA-F]").alias("f_hex"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("f_distinct"), (turns / n).alias("f_turns"), (vowel_turns / n).alias("f_vowel_turns"),
        (F.coalesce("covered", F.lit(0)) / n).alias("f_dictionary"),
        (F.col("word").rlike(r"://|^[./~]|\.[a-z]{2,4}$") | (F.regexp_count(v, F.lit("/")) >= 2)).cast("double").alias("f_path"),
        around.rlike(NAMES).cast("double").alias("f_named"), (F.col("before").rlike(r"[=:]$") | F.col("word").rlike("=")).cast("double").alias("f_assigned"), F.col("word").rlike("[\"']").cast("double").alias("f_quoted"),
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """found with label 1 for clear secrets, 0 for clear false positives, null for the rest."""
    random_looking = (F.col("f_length") >= 12) & (F.col("f_turns") > 0.1) & (F.col("f_dictionary") < 0.5)
    secret = F.col("value").rlike(ISSUED) | ((F.col("f_named") == 1) & (F.col("f_assigned") == 1) & random_looking)
    harmless = (F.col("f_digits") == 1) | (F.col("f_path") == 1) | (F.col("f_dictionary") >= 0.7) | F.col("value").rlike("^[0-9_+/-]+$") | ((F.col("f_named") == 0) & (F.col("f_turns") <= 0.1))
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def fit(labelled: DataFrame, sample_rows: int = 20000, trees: int = 20, depth: int = 6) -> PipelineModel | None:
    """A forest from findings with label 0 or 1, of which about sample_rows are used, half of either class if there are as many."""
    counts = {r["label"]: r["count"] for r in labelled.where("label in (0.0, 1.0)").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    draw = (F.xxhash64("value", "before", "text_key", "place") / F.lit(float(1 << 63)) + 1) / 2
    enough = F.when(F.col("label") == 1, F.lit(sample_rows / 2 / counts[1.0])).otherwise(F.lit(sample_rows / 2 / counts[0.0]))
    sample = labelled.where("label in (0.0, 1.0)").where(draw < enough).select("label", *FEATURES)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="f_all")
    forest = RandomForestClassifier(
        featuresCol="f_all", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, maxMemoryInMB=64,
    ).fit(assembler.transform(sample))
    return PipelineModel([assembler, forest])


def held_out_figures(labelled: DataFrame, share: float = 0.2, threshold: float = 0.5, **how) -> dict[str, float]:
    """Precision and recall against the labels of findings in held-out texts, of a forest fit to those of the other texts."""
    out = F.pmod(F.xxhash64(F.lit("held out"), "text_key"), F.lit(1000)) < 1000 * share
    model = fit(labelled.where(~out), **how)
    if model is None:
        return {}
    judged = model.transform(labelled.where(out & F.col("label").isNotNull())).select(
        "label", (vector_to_array("probability")[1] >= threshold).cast("double").alias("found"),
    )
    n = {(r["label"], r["found"]): r["count"] for r in judged.groupBy("label", "found").count().collect()}
    hit, wrong, lost = n.get((1.0, 1.0), 0), n.get((0.0, 1.0), 0), n.get((1.0, 0.0), 0)
    return {"precision": hit / max(1, hit + wrong), "recall": hit / max(1, hit + lost), "positives": hit + lost, "negatives": wrong + n.get((0.0, 0.0), 0)}


def findings(docs: DataFrame, labels=rule_labels, threshold: float = 0.5, **how) -> DataFrame:
    """(doc_id, text_key, place, word, before, value, probability, is_secret) of every candidate in docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = written(candidates(docs), "candidates")
    labelled = written(labels(described(found, dictionary(docs))), "labelled")
    model = fit(labelled, **how)
    if model is None:
        judged = labelled.withColumn("probability", F.coalesce("label", F.lit(0.0)))
    else:
        judged = model.transform(labelled).withColumn("probability", vector_to_array("probability")[1])
    return judged.select(*found.columns, "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", **how) -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars, if it has that, set to the new length where text changed."""
    secrets = findings(docs, **how).where("is_secret")
    of_text = secrets.groupBy(F.col("text_key").alias("__key")).agg(
        F.array_sort(F.collect_set("value"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)).alias("__values")
    )
    joined = docs.join(of_text, F.md5(docs.text.cast("binary")) == F.col("__key"), "left")
    clean = F.aggregate("__values", F.col("text"), lambda text, value: F.replace(text, value, F.lit(mark)))
    text = F.when(F.col("__values").isNotNull(), clean).otherwise(F.col("text"))
    length = lambda c: F.when(F.col("__values").isNotNull(), F.length(clean).cast(docs.schema[c].dataType)).otherwise(F.col(c))
    return joined.select(*(text.alias(c) if c == "text" else length(c).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, place, n_chars, value_sha256, probability, is_secret: one row a candidate."""
    found = findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")
