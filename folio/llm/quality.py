"""Quality rules: robust multivariate outliers among text statistics. DataFrame functions throughout.

Every text becomes a vector of four transformed statistics: log mean word length, and the square roots of the shares of symbols,
repeated lines and repeated words. For each group (language and source; groups of fewer than `least` rows are pooled by
language, then all together) the minimum-covariance-determinant estimate is looked for from four starts: medians and median
deviations; the correlations of the hyperbolic tangents and of the spatial signs of the standardised rows, with these scales;
and mean and covariance of the half of least norm. From each, concentration steps follow: the rows of least distance, a share
`coverage` of the group, give a new mean and covariance, which can't raise the determinant (but for the quantile sketch's
error). The first `trial` steps take half of the group's rows, which leads further away from outliers that lie close; then the two
starts of least determinant go on until no determinant changes by more than `tolerance` (relatively) or `steps` are done, and
the one of least determinant is the estimate. Distances are scaled by the group's median
to the chi-square distribution. A row is rejected if its squared Mahalanobis distance exceeds the chi-square quantile at
`confidence`; nothing else enters the verdict. Length is no part of the vector: long and short texts are no worse for it.

A statistic that most rows of a group have at exactly the same value (no repeated line, say) has no spread of its own, so
every statistic has a resolution, RESOLUTION, whose square is added to its variance: smaller differences count for little.

Moments and quantile sketches are aggregated before the shuffle, and only some rows a group are joined back, so a group may hold
any share of the rows. The inverse is a Cholesky factor written out in column expressions.

Null and empty texts have no words and fail the base rule. Null language or source is a group of its own. Groups that are too
small even together are judged by the base rule alone. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import table, written

SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
D = 4
X = [f"x{i}" for i in range(D)]
LOWER = [(i, j) for i in range(D) for j in range(i + 1)]
#: Into how many parts a group may be dealt.
SALTS = 32
#: Standard deviations below which a statistic is not told apart, added in squares to the covariance.
RESOLUTION = (0.05, 0.03, 0.15, 0.2)


def chi_square(share: float) -> float:
    """The quantile of the chi-square distribution with four degrees of freedom, whose upper tail is exp(-x/2) (1 + x/2)."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < share else (low, x)
    return low


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id", "lang", "source", F.array_remove(F.split("text", SPLIT), "").alias("words"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines")
    )
    words = F.col("words")
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    )
    two = one.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        windows.alias("windows"),
    )
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    three = two.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    near = lambda k, d: F.coalesce(F.get("sorted", k)["h"] == F.get("sorted", k + d)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: F.when(k > 0, near(k, -1)).otherwise(False) | near(k, 1))
    four = three.withColumn("places", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(found, lambda k: F.get("sorted", k)["i"])))).drop("sorted")
    covered = F.aggregate(F.sequence(F.lit(0), F.size("places") - 1), F.lit(0), lambda acc, k: acc + F.least(
        F.lit(3), F.coalesce(F.get("places", k + 1) - F.get("places", k), F.lit(3)),
    ))
    return four.withColumn("n_repeat_words", F.when(F.col("places").isNotNull(), covered).otherwise(0).cast("long")).drop("places")


def with_vector(stats: DataFrame) -> DataFrame:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    vector = (F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n))
    return stats.withColumns(dict(zip(X, vector, strict=True)))


def with_group(rows: DataFrame, least: int) -> DataFrame:
    """rows with group: language and source, or a pool of groups of fewer than least rows that count (used)."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    fine, coarse = F.to_json(F.struct(name("lang").alias("l"), name("source").alias("s"))), F.to_json(F.struct(name("lang").alias("l")))
    named = rows.withColumns({"fine": fine, "coarse": coarse})
    sizes = named.groupBy("fine", "coarse").agg(F.count(F.when(F.col("used"), 1)).alias("n"))
    pools = sizes.where(F.col("n") < least).groupBy(F.col("coarse").alias("c")).agg(F.sum("n").alias("pool"))
    choice = sizes.join(pools, F.col("coarse") == F.col("c"), "left").select(
        F.col("fine").alias("f"),
        F.when(F.col("n") >= least, F.col("fine")).when(F.col("pool") >= least, F.col("coarse")).otherwise(F.lit("rest")).alias("group"),
    )
    return named.join(choice, F.col("fine") == F.col("f")).drop("fine", "coarse", "f")


def with_factor(moments: DataFrame) -> DataFrame:
    """group, start, m0.., the lower Cholesky factor l00.. and logdet from means m0.. and covariances c00.."""
    out = moments
    for i, j in LOWER:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, D)), 2 * F.log("l00"))
    return out.select("group", "start", *(f"m{i}" for i in range(D)), *(f"l{i}{j}" for i, j in LOWER), logdet.alias("logdet"))


def covariances(rows: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """keys, m0.. and c00.. of the rows (x0..), the squares of RESOLUTION added to the diagonal."""
    of = lambda c: F.avg(c if where is None else F.when(where, c))
    sums = rows.groupBy(*keys).agg(
        *(of(F.col(x)).alias(f"m{i}") for i, x in enumerate(X)), *(of(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in LOWER),
    )
    return sums.select(
        *keys,
        *(f"m{i}" for i in range(D)),
        *((F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (RESOLUTION[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in LOWER),
    )


def salted(rows: DataFrame, per_group: DataFrame, how: str = "inner") -> DataFrame:
    """rows (group, salt) with the columns of per_group (group). The few rows of per_group are repeated for every salt, so that
    a large group is dealt to many tasks, and sums over groups that follow are shuffled anew, after partial aggregation."""
    repeated = per_group.withColumnRenamed("group", "__g").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(repeated, (F.col("group") == F.col("__g")) & (F.col("salt") == F.col("__s")), how).drop("__g", "__s")


def with_distance(rows: DataFrame, factors: DataFrame, how: str = "inner") -> DataFrame:
    """rows with d2, their squared Mahalanobis distance, by forward substitution, for each factor of their group."""
    out = salted(rows, factors, how)
    for i in range(D):
        z = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, D)), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", total).drop(*(f"z{i}" for i in range(D)), *(f"m{i}" for i in range(D)), *(f"l{i}{j}" for i, j in LOWER))


def median(c: Column | str) -> Column:
    return F.percentile_approx(c, F.lit(0.5), F.lit(1000))


def starts(used: DataFrame) -> DataFrame:
    """Four factors of each group of the rows (group, salt, x0..) to begin with."""
    centre = used.groupBy("group").agg(*(median(x).alias(f"m{i}") for i, x in enumerate(X)))
    spread = salted(used, centre).groupBy("group").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(D)), *(median(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"a{i}") for i, x in enumerate(X)),
    )
    spread = written(
        spread.select(
            "group", *(f"m{i}" for i in range(D)), *(F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, 2) + RESOLUTION[i] ** 2).alias(f"s{i}") for i in range(D)),
        ),
        "spread",
    )
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(X)]
    norm = sum((c * c for c in z[1:]), z[0] * z[0])
    placed = salted(used, spread).select("group", "salt", *X, *(c.alias(f"z{i}") for i, c in enumerate(z)), norm.alias("norm"))
    tanh, sign = [F.tanh(f"z{i}") for i in range(D)], [F.col(f"z{i}") / F.sqrt(F.greatest("norm", F.lit(1e-12))) for i in range(D)]
    both = placed.groupBy(F.col("group").alias("g")).agg(
        median("norm").alias("half"), *(F.avg(v[i] * v[j]).alias(f"{n}{i}{j}") for n, v in (("t", tanh), ("u", sign)) for i, j in LOWER),
    )
    known = spread.join(both, F.col("group") == F.col("g")).drop("g")
    of = lambda name, c: known.select("group", F.lit(name).alias("start"), *(f"m{i}" for i in range(D)), *((c(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in LOWER))
    share = lambda n: lambda i, j: F.lit(1.0) if i == j else F.coalesce(F.col(f"{n}{i}{j}") / F.nullif(F.sqrt(F.col(f"{n}{i}{i}") * F.col(f"{n}{j}{j}")), F.lit(0.0)), F.lit(0.0))
    near = covariances(salted(placed, known.select("group", "half")).where("norm <= half"), "group").withColumn("start", F.lit("half"))
    alone = of("deviations", lambda i, j: F.lit(1.0 if i == j else 0.0))
    return written(with_factor(alone.unionByName(of("tanh", share("t"))).unionByName(of("signs", share("u"))).unionByName(near)), "starts")


def concentrated(used: DataFrame, factors: DataFrame, coverage: float) -> DataFrame:
    """The factors of the rows of least distance under each of factors."""
    near = with_distance(used, factors.drop("logdet")).select("group", "salt", "start", *X, "d2")
    limit = near.groupBy("group", "start").agg(F.percentile_approx("d2", F.lit(coverage), F.lit(1000)).alias("limit")).withColumnRenamed("start", "__start")
    core = salted(near, limit).where("start = __start and d2 <= limit")
    return written(with_factor(covariances(core, "group", "start")), "factors")


def least_determinants(factors: DataFrame, n: int) -> DataFrame:
    """The n factors of least determinant of each group, of which there are but a few."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy("logdet", "start"))
    return factors.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def robust_factors(rows: DataFrame, coverage: float = 0.75, trial: int = 4, steps: int = 20, tolerance: float = 1e-3) -> DataFrame:
    """group, means, Cholesky factor, logdet and scale of the used rows (group, salt, x0..) of each group."""
    used = rows.where("used").select("group", "salt", *X)
    factors = starts(used)
    for share in [0.5] * trial + [coverage]:
        factors = concentrated(used, factors, share)
    factors = written(least_determinants(factors, 2), "factors")
    for _ in range(steps):
        now = concentrated(used, factors, coverage)
        before = factors.select(F.col("group").alias("g"), F.col("start").alias("s"), F.col("logdet").alias("before"))
        change = now.join(
            before, (F.col("group") == F.col("g")) & (F.col("start") == F.col("s")),
        ).agg(F.max(F.abs(F.exp(F.col("logdet") - F.col("before")) - 1))).first()[0]
        factors = now
        if change is None or change <= tolerance:
            break
    factors = least_determinants(factors, 1).drop("start")
    scale = with_distance(used, factors.drop("logdet")).groupBy(F.col("group").alias("g")).agg(
        F.greatest(F.lit(1.0), median("d2") / chi_square(0.5)).alias("scale")
    )
    return written(factors.join(scale, F.col("group") == F.col("g")).drop("g"), "estimates")


def judged(docs: DataFrame, least: int = 100, confidence: float = 0.9999, **how) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, d2 and kept of every row of docs (doc_id, text, lang, source)."""
    stats = text_statistics(docs)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = written(
        with_group(
            written(with_vector(stats.withColumn("base_failed", failed)).withColumn("used", ~F.col("base_failed")), "statistics"), least,
        ).withColumn("salt", F.pmod(F.xxhash64("doc_id", *X), F.lit(SALTS)).cast("int")),
        "grouped",
    )
    counts = rows.where("used").groupBy(F.col("group").alias("gc")).agg(F.count("*").alias("n_used"))
    factors = robust_factors(rows, **how).join(counts, F.col("group") == F.col("gc")).where(F.col("n_used") >= least).drop("gc", "n_used")
    far = with_distance(rows, factors.drop("logdet"), "left").withColumn("d2", F.col("d2") / F.col("scale"))
    outlier = F.coalesce(F.col("d2") > chi_square(confidence), F.lit(False))
    return far.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "d2",
        (~F.col("base_failed") & ~outlier).alias("kept"),
    )


def op4_robust_outliers(spark, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance"))
