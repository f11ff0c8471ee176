"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions throughout.

Documents are summed into cells (one for each combination of the dimensions' values that occurs). The cells' token weights
are raked: for each dimension in turn they are scaled so that its margins meet the targets, for a fixed number of rounds; how
far the margins then are from their targets is measured, and targets that can't be met together raise a warning. A
cell's multiplier is its raked weight over its tokens. Documents are then drawn one by one with probability
min(1, scale * multiplier), where the scale makes the expected tokens a given share of all; cells that would exceed 1 are
held at 1 and the scale is solved for the others. A document's draw is a hash of its doc_id, so it is the same in every run.

Only the cells' totals are iterated over. A margin is a sum that is aggregated before its shuffle and joined back to the cells,
so a value with any number of cells is dealt to many tasks. A document meets its cell by an equi-join that Spark may broadcast
or split; no document is grouped. Nulls in a dimension are a value of their own (shown as null). Null or
empty texts have no tokens and get their cell's probability; a cell without tokens has multiplier 0. Rows with equal doc_id,
or null ones, are drawn alike. An empty table gives an empty result. Extra columns are kept by `mixed`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import table, written

DIMENSIONS = ("source", "lang", "topic")
WORDS = r"[^\x20\x09-\x0D]+"
#: Targets where none are given: margins in proportion to tokens to these powers, so that small values gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def text_form(text: Column, words: Column) -> Column:
    """The topic of tables that name none: table, list, short, long or prose, by bars, lines and words."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.isNull() | (words == 0), "none").when(bars * 10 >= words, "table").when(lines * 8 >= words, "list").when(words < 100, "short").when(words >= 1000, "long").otherwise("prose")


def flattened(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): targets in proportion to the margin's tokens to a power."""
    margin = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raised = margin.select("value", F.pow("tokens", F.lit(power)).alias("raised"))
    total = raised.agg(F.sum("raised")).first()[0] or 1.0
    return raised.select("value", (F.col("raised") / F.lit(total)).alias("share"))


def with_margin(cells: DataFrame, dimension: str) -> DataFrame:
    """cells with __total, the weight of all cells of their value."""
    margin = cells.groupBy(F.col(dimension).alias("__v")).agg(F.sum("weight").alias("__total"))
    return cells.join(margin, F.col(dimension).eqNullSafe(F.col("__v"))).drop("__v")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 10, tolerance: float = 0.01) -> DataFrame:
    """cells with weight: their tokens, raked to the targets' shares (weights sum to 1). Values without a target get 0.

    Warns if, after all rounds, a margin's shares are off by more than tolerance in sum."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        now = now.join(
            target.select(F.col("value").alias("__v"), F.col("share").alias(f"__goal_{dimension}")), F.col(dimension).eqNullSafe(F.col("__v")), "left",
        ).drop("__v").withColumn(f"__goal_{dimension}", F.coalesce(f"__goal_{dimension}", F.lit(0.0)))
    now = written(now, "raked")
    for _ in range(rounds):
        for dimension in targets:
            scaled = F.when(F.col("__total") > 0, F.col("weight") * (F.col(f"__goal_{dimension}") / F.col("__total"))).otherwise(0.0)
            now = written(with_margin(now, dimension).withColumn("weight", scaled).drop("__total"), "raked")  # now occurs twice in it
    errors = margin_errors(now, list(targets))
    if errors and max(errors.values()) > tolerance:
        warnings.warn(f"raking has not met its targets; the margins are off by {errors}", stacklevel=2)
    return now.drop(*(f"__goal_{d}" for d in targets))


def margin_errors(raked: DataFrame, dimensions: list[str]) -> dict[str, float]:
    """By dimension, the sum of the differences between the raked shares and their targets, over all values with tokens."""
    out = {}
    for d in dimensions:
        margin = raked.groupBy(d).agg(F.sum("weight").alias("w"), F.first(f"__goal_{d}").alias("goal"), F.sum("tokens").alias("tokens")).where("tokens > 0")
        out[d] = margin.agg(F.sum(F.abs(F.col("w") - F.col("goal")))).first()[0] or 0.0
    return out


def probabilities(raked: DataFrame, share: float) -> DataFrame:
    """raked cells with multiplier and probability, such that share of all tokens is expected."""
    cells = written(raked.withColumn("multiplier", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    budget, least, scale = share * total, None, 0.0
    while True:  # the cells held at 1 are those of multiplier `least` and above; each turn adds some, or ends
        held = F.lit(False) if least is None else F.col("multiplier") >= least
        sums = cells.agg(F.sum(F.when(held, F.col("tokens"))).alias("full"), F.sum(F.when(~held, F.col("multiplier") * F.col("tokens"))).alias("rest")).first()
        if not sums["rest"]:
            scale = float("inf") if least is not None else 0.0
            break
        scale = max(0.0, (budget - (sums["full"] or 0)) / sums["rest"])
        over = cells.where(~held & (F.col("multiplier") * scale > 1)).agg(F.min("multiplier")).first()[0]
        if over is None:
            break
        least = over
    full = F.lit(False) if least is None else F.col("multiplier") >= least
    return cells.withColumn("probability", F.when(full, 1.0).when(F.col("multiplier") > 0, F.least(F.lit(1.0), F.col("multiplier") * scale)).otherwise(0.0))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from doc_id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def weighed(
    docs: DataFrame, share: float = 0.5, dimensions: tuple[str, ...] = DIMENSIONS, targets: dict[str, DataFrame] | None = None, rounds: int = 10,
) -> DataFrame:
    """docs (with n_tokens and the dimensions' columns) with multiplier, probability, draw and sampled."""
    cells = written(docs.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens")), "cells")
    goals = targets or {d: written(flattened(cells, d, POWERS.get(d, 0.5)), "targets") for d in dimensions}
    found = probabilities(rake(cells, goals, rounds), share)
    right = found.select(*(F.col(d).alias(f"__{d}") for d in dimensions), "multiplier", "probability")
    same = F.lit(True)
    for d in dimensions:
        same = same & F.col(d).eqNullSafe(F.col(f"__{d}"))
    return docs.join(right, same).drop(*(f"__{d}" for d in dimensions)).withColumn("draw", draw(F.col("doc_id"))).withColumn("sampled", F.col("draw") < F.col("probability"))


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with n_tokens (words) and topic instead of text."""
    words = n_words(F.col("text"))
    return docs.withColumn("n_tokens", words).withColumn("topic", text_form(F.col("text"), F.col("n_tokens"))).drop("text")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, source, lang, topic, n_tokens, multiplier, probability, draw, sampled."""
    docs = written(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")), "tokens")
    return weighed(docs).select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "n_tokens",
        F.round("multiplier", 9).alias("multiplier"),
        F.round("probability", 6).alias("probability"),
        F.round("draw", 9).alias("draw"),
        "sampled",
    )


def mixed(docs: DataFrame, share: float = 0.7) -> DataFrame:
    """docs of which documents are drawn by their calibrated probabilities; all columns stay as they are."""
    own = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    kept = weighed(written(with_tokens(own), "tokens"), share).where("sampled").select(
        F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("probability").alias("__p"),
    ).distinct()
    kept = written(kept, "kept")  # its size is known then, so that texts are not shuffled to meet a few cells
    marked = docs.withColumn("__words", n_words(docs.text)).withColumn("__form", text_form(docs.text, F.col("__words")))
    same = marked["source"].cast("string").eqNullSafe(F.col("__s")) & marked["lang"].cast("string").eqNullSafe(F.col("__l")) & (F.col("__form") == F.col("__t"))
    return marked.join(kept, same).where(draw(marked["doc_id"]) < F.col("__p")).select(*(marked[c] for c in docs.columns))


def mix_sql(rounds: int = 10, share: float = 0.5) -> str:
    """The same rows as op3 in DuckDB's SQL."""
    parts = [
        r"""d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, text IS NULL AS none, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS n_tokens FROM documents)""",
        r"""t AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN none OR n_tokens = 0 THEN 'none' WHEN (length(text) - length(replace(text, '|', ''))) * 10 >= n_tokens THEN 'table' WHEN (length(text) - length(replace(text, chr(10), ''))) * 8 >= n_tokens THEN 'list' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM d)""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM t GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(
            f"g_{d} AS MATERIALIZED (SELECT {d} AS v, pow(sum(tokens), {POWERS[d]}) / sum(pow(sum(tokens), {POWERS[d]})) OVER () AS share FROM w0 GROUP BY {d} HAVING sum(tokens) > 0)"
        )
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            parts.append(f"s{k} AS MATERIALIZED (SELECT {d} AS v, sum(weight) AS total FROM w{k} GROUP BY {d})")
            parts.append(
                f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN total > 0 THEN weight * (coalesce(share, 0) / total) ELSE 0 END AS weight FROM w{k} JOIN s{k} ON w{k}.{d} IS NOT DISTINCT FROM s{k}.v LEFT JOIN g_{d} g ON s{k}.v IS NOT DISTINCT FROM g.v)"
            )
            k += 1
    parts += [
        f"c AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS multiplier FROM w{k})",
        "o AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY multiplier DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(tokens) OVER (PARTITION BY multiplier) AS above, sum(multiplier * tokens) OVER (ORDER BY multiplier DESC RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS total FROM c)",
        f"q AS (SELECT max(multiplier) AS top FROM o WHERE rest > 0 AND multiplier * ({share} * total - above) / rest <= 1)",
        f"p AS (SELECT c.source, c.lang, c.topic, c.multiplier, CASE WHEN q.top IS NULL OR c.multiplier > q.top THEN 1.0 ELSE c.multiplier * (SELECT max(({share} * total - above) / rest) FROM o, q WHERE o.multiplier = q.top) END AS probability FROM c, q)",
    ]
    return "WITH " + ", ".join(parts) + " SELECT doc_id, t.source, t.lang, t.topic, n_tokens, round(multiplier, 9) AS multiplier, round(probability, 6) AS probability, round(u, 9) AS draw, u < probability AS sampled FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS u FROM t) t JOIN p ON t.source IS NOT DISTINCT FROM p.source AND t.lang IS NOT DISTINCT FROM p.lang AND t.topic = p.topic"
