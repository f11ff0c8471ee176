"""URL filters: rules by host and path, then trust and distrust spread over the host graph. DataFrame functions throughout.

Hosts are linked by the absolute links in their pages' html, and by containment (a host and the domain one label up, both
ways). Trust is a personalised PageRank from trusted seeds along the links; distrust is the same from blocked seeds against
them, so that it reaches those who link to what is blocked. Seeds come from the rules: a host's share of pages that they
allow, less the share that they block, is its weight as a trusted seed if positive, as a blocked one if negative and most of
its pages are blocked. A host is blocked if it has more distrust than trust and more than `least` times an average host's.

Each power step is two equi-joins of edges with ranks and one sum, which Spark aggregates before the shuffle, and its result
is a written table every second step, so that a lost executor costs few steps. Rank that reaches a host without links on is
to go back to the seeds: the fixed point of that is in proportion to the one without, so ranks are divided by their sum at the
end. Steps are taken until one changes trust and distrust by less than `tolerance` of their sums together; if `steps` of them
don't reach that, it is an error.

A null url or one without :// has empty host and path, fits no rule and is no node: it is allowed. Null html has no links.
Repeated rows count as pages each and are judged alike. Where no page is a seed, only rules block. Of rules that fit, the
longest wins, then the one that sorts first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table, written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"
#: The rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, CAPITALS, SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of the hosts that rules fit by name: the rules, best first. A host's list is as long as the rules that name it."""
    above = hosts.where("host != ''").select("host", F.explode(suffixes(F.col("host"))).alias("above"))
    fit = above.join(rules, F.col("above") == F.col("rule_host")).select(
        "host",
        F.struct(
            (-F.length(F.concat("rule_host", "rule_path"))).alias("order"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "verdict",
        ).alias("r"),
    )
    return fit.groupBy("host").agg(F.sort_array(F.collect_set("r")).alias("rules"))


def best_rule(rules: Column, path: Column) -> Column:
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["rule_path"])), F.lit(0))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, with their count, and containment, with weight 1."""
    linked = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = linked.select("src", F.translate("dst", CAPITALS, SMALL).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    known = links.select(F.col("dst").alias("host")).union(hosts.select("host")).where("host != ''").distinct()
    chain = known.select(F.explode(suffixes(F.col("host"))).alias("host")).where("host like '%.%'").distinct()
    up = chain.select(F.col("host").alias("low"), F.regexp_replace("host", r"^[^.]*\.", "").alias("top")).where("top like '%.%'")
    ladder = up.select(
        F.explode(
            F.array(F.struct(F.col("low").alias("src"), F.col("top").alias("dst")), F.struct(F.col("top").alias("src"), F.col("low").alias("dst")))
        ).alias("e")
    ).select("e.src", "e.dst", F.lit(1.0).alias("weight"))
    return links.union(ladder).where("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, steps: int = 100, damping: float = 0.85, tolerance: float = 0.01, every: int = 4) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, weight) and seeds (host, good, bad), each of which sums to 1 or is 0."""
    out = edges.groupBy(F.col("src").alias("o")).agg(F.sum("weight").alias("w_out"))
    into = edges.groupBy(F.col("dst").alias("i")).agg(F.sum("weight").alias("w_in"))
    edges = written(
        edges.join(out, F.col("src") == F.col("o")).join(into, F.col("dst") == F.col("i")).select(
            "src", "dst", (F.col("weight") / F.col("w_out")).alias("along"), (F.col("weight") / F.col("w_in")).alias("against"),
        ),
        "edges",
    )
    own = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    ranks = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    relative = float("inf")
    for step in range(1, steps + 1):
        good = edges.join(ranks.where("trust > 0"), F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (F.col("along") * F.col("trust") * damping).alias("trust"), F.lit(0.0).alias("distrust"),
        )
        bad = edges.join(ranks.where("distrust > 0"), F.col("dst") == F.col("host")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("against") * F.col("distrust") * damping).alias("distrust"),
        )
        now = own.union(good).union(bad).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        check = step % every == 0 or step == steps
        before, ranks = ranks, written(now, "ranks") if check or step % 2 == 0 else now
        if check:
            both = ranks.select("host", "trust", "distrust", F.col("trust").alias("t"), F.col("distrust").alias("d"))
            both = both.union(before.select("host", F.lit(0.0), F.lit(0.0), -F.col("trust"), -F.col("distrust"))).groupBy("host").agg(
                *(F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")),
            )
            r = both.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.sum(F.abs("t")).alias("t"), F.sum(F.abs("d")).alias("d")).first()
            relative = sum((r[c] or 0.0) / r[total] for c, total in (("t", "trust"), ("d", "distrust")) if r[total])
            if relative <= tolerance:
                sums = {c: r[c] or 1.0 for c in ("trust", "distrust")}
                return ranks.select("host", *((F.col(c) / F.lit(n)).alias(c) for c, n in sums.items()))
    raise RuntimeError(f"ranks still change by {relative} after {steps} steps")


def judged(pages: DataFrame, rules: DataFrame, least: float = 1.0, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_trust, host_distrust) of every row of pages (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    light = written(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    fit = written(host_rules(light.select("host").distinct(), rules), "rules")
    ruled = light.join(fit.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").withColumn("best", best_rule(F.col("rules"), F.col("path")))
    hosts = written(
        ruled.groupBy("host").agg(
            F.count("*").alias("pages"),
            F.count(F.when(F.col("best.verdict") == "allow", 1)).alias("good"),
            F.count(F.when(F.col("best.verdict") == "block", 1)).alias("bad"),
        ),
        "hosts",
    )
    lead = (F.col("good") - F.col("bad")) / F.col("pages")
    raw = hosts.where("host != ''").select(
        "host", F.greatest(lead, F.lit(0.0)).alias("good"), F.when(F.col("bad") * 2 > F.col("pages"), F.greatest(-lead, F.lit(0.0))).otherwise(0.0).alias("bad"),
    )
    sums = raw.agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count("*").alias("n")).first()
    seeds = written(raw.select("host", (F.col("good") / F.lit(sums["g"] or 1.0)).alias("good"), (F.col("bad") / F.lit(sums["b"] or 1.0)).alias("bad")), "seeds")
    edges = host_edges(pages.select(host.alias("host"), "html"), hosts)
    ranks = spread(edges, seeds, **how)
    n = float(max(1, sums["n"]))
    per_host = hosts.select(F.col("host").alias("h")).join(fit.withColumnRenamed("host", "f"), F.col("h") == F.col("f"), "left").join(ranks, F.col("h") == F.col("host"), "left").select(
        "h", "rules", F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"),
    )
    by_graph = F.when((F.col("host_distrust") > F.col("host_trust")) & (F.col("host_distrust") * n > least), "block").otherwise("allow")
    best = best_rule(F.col("rules"), F.col("path"))
    return light.join(per_host, F.col("host") == F.col("h")).select(
        "page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], by_graph).alias("verdict"), "host_trust", "host_distrust",
    )


def op7_link_graph(spark, sf_dir: str) -> DataFrame:
    """pages -> page_id, host, path, rule, verdict, host_trust, host_distrust."""
    return judged(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
