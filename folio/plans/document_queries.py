"""Validation, relations, versions, policies, encryption, hooks and streams over the tables as document classes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.functions import crypto
from folio.operators import relations, validation
from folio.operators.hooks import Trigger, apply_triggers
from folio.operators.policies import Policy, Session, allowed
from folio.operators.rows import sequential_ids
from folio.plans.registry import query, tables
from folio.sources.documents import latest, merge
from folio.sources.schema import Attribute, ClassModel
from folio.sources.store import scratch
from folio.streaming.feeds import current, last_batch, live_view, replicate, windowed_counts

PART = ClassModel(
    "part",
    (
        Attribute("p_partkey", "integer", mandatory=True, primary_key=True), Attribute("p_name", max_length=12), Attribute(
            "p_brand", "enum", values=("Brand#1", "Brand#2", "Brand#3"),
        ),
        Attribute("p_size", "integer", min=5, max=45), Attribute("p_retailprice", "decimal", precision=1),
    ),
)


@query(
    "m1_rule_counts",
    """SELECT rule, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN length(p_name) > 12 THEN 'p_name.max_length' END, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'p_brand.enum' END,
    CASE WHEN p_size < 5 THEN 'p_size.min' END, CASE WHEN p_size > 45 THEN 'p_size.max' END, CASE WHEN p_retailprice <> round(p_retailprice, 1) THEN 'p_retailprice.precision' END], lambda x: x IS NOT NULL)) AS rule FROM part) GROUP BY rule""",
)
def rule_counts(spark, d):
    return validation.rule_counts(tables(spark, d, "part"), PART)


@query(
    "m1_valid_rows",
    "SELECT p_partkey FROM part WHERE length(p_name) <= 12 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size BETWEEN 5 AND 45 AND p_retailprice = round(p_retailprice, 1)",
)
def valid_rows(spark, d):
    return validation.with_violations(tables(spark, d, "part"), PART).where(F.size("violations") == 0).select("p_partkey")


@query("m2_missing_targets", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def missing(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    return validation.missing_targets(orders, "o_custkey", customer.where("c_acctbal >= 0"), "c_custkey").select("o_orderkey")


@query(
    "m3_key_clashes",
    "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49 AND (l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 GROUP BY 1 HAVING count(*) > 1) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))",
)
def clashes(spark, d):
    fresh = tables(spark, d, "lineitem").where("l_quantity > 49").select("l_orderkey")
    stored = tables(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return validation.key_clashes(fresh, stored, ["l_orderkey"])


SUPPLIES = relations.Domain("supplies", "1:N", "supplier", "part")


def _supply_edges(spark, d):
    return relations.edges_of(SUPPLIES, tables(spark, d, "lineitem").select(F.col("l_suppkey").alias("sourceId"), F.col("l_partkey").alias("targetId")))


@query("s9_domain_scan", "SELECT DISTINCT 'supplies' AS domain, l_suppkey::VARCHAR AS \"sourceId\", l_partkey::VARCHAR AS \"targetId\" FROM lineitem")
def domain_scan(spark, d):
    return _supply_edges(spark, d).where("`~domain` = 'supplies'").select(F.col("`~domain`").alias("domain"), "sourceId", "targetId").distinct()


@query(
    "m6_cardinality",
    "SELECT 'targetId' AS side, l_partkey::VARCHAR AS id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1",
)
def cardinality(spark, d):
    return relations.cardinality_clashes(SUPPLIES, _supply_edges(spark, d))


@query(
    "m10_broken_edges",
    "SELECT DISTINCT 'targetId' AS reason, l_partkey::VARCHAR AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)",
)
def broken(spark, d):
    s, p = tables(spark, d, "supplier", "part")
    found = relations.broken_edges(
        SUPPLIES,
        _supply_edges(spark, d),
        s.select(F.col("s_suppkey").cast("string").alias("_id")),
        p.where("p_size > 3").select(F.col("p_partkey").cast("string").alias("_id")),
    )
    return found.select("reason", F.col("targetId").alias("id")).distinct()


@query("m7_edges_added_and_removed", "SELECT n_regionkey::VARCHAR AS \"sourceId\", n_nationkey::VARCHAR AS \"targetId\" FROM nation WHERE n_nationkey >= 5")
def edges(spark, d):
    holds = relations.Domain("holds", "1:N", "region", "nation")
    pairs = tables(spark, d, "nation").select(F.col("n_regionkey").alias("sourceId"), F.col("n_nationkey").alias("targetId"))
    all_ = relations.edges_of(holds, pairs)
    once = relations.add_edges(all_.where("targetId < 20"), all_)
    return relations.remove_edges(once, "holds", pairs.where("targetId < 5")).select("sourceId", "targetId")


@query("m9_reference_edges", "SELECT n_regionkey::VARCHAR AS \"sourceId\", n_nationkey::VARCHAR AS \"targetId\" FROM nation")
def reference(spark, d):
    holds = relations.Domain("holds", "1:N", "region", "nation")
    docs = tables(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_regionkey").cast("string").alias("region"))
    return relations.reference_edges(holds, docs, "nation", "region").select("sourceId", "targetId")


@query(
    "m11_schema_propagation",
    "SELECT s_suppkey, s_name, CAST(s_acctbal AS BIGINT) AS s_acctbal, 'new' AS note, NULL::VARCHAR AS phone FROM supplier WHERE s_acctbal = floor(s_acctbal) UNION ALL SELECT s_suppkey, s_name, CAST(trunc(s_acctbal) AS BIGINT), 'new', NULL FROM supplier WHERE s_acctbal <> floor(s_acctbal)",
)
def schema_change(spark, d):
    old = ClassModel(
        "supplier", (Attribute("s_suppkey", "integer"), Attribute("s_name"), Attribute("s_nationkey", "integer"), Attribute("s_acctbal", "decimal")),
    )
    new = old.without_attribute("s_nationkey").with_attribute(Attribute("note", default="new")).with_attribute(Attribute("phone")).with_attribute(Attribute("s_acctbal", "integer"))
    return validation.propagate(tables(spark, d, "supplier"), old, new).select("s_suppkey", "s_name", "s_acctbal", "note", "phone")


@query(
    "m12_latest_by_id",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_by_id(spark, d):
    return latest(tables(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("s11_upsert_merge", "SELECT c.c_custkey, c_name, CASE WHEN c.c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer c")
def upsert(spark, d):
    stored = tables(spark, d, "customer").select(F.col("c_custkey"), "c_name", "c_acctbal").withColumn("_rev", F.lit(1))
    changed = merge(
        stored.drop("_rev"), stored.where("c_custkey % 3 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")), "c_custkey",
    ).withColumn("_rev", F.lit(2))
    return latest(stored.unionByName(changed), "c_custkey").drop("_rev")


@query("s14_soft_delete", "SELECT p_partkey, p_name FROM part WHERE p_size <> 7")
def soft_delete(spark, d):
    stored = tables(spark, d, "part").select("p_partkey", "p_name", "p_size").withColumns({"_rev": F.lit(1), "active": F.lit(True)})
    gone = stored.where("p_size = 7").withColumns({"_rev": F.lit(2), "active": F.lit(False)})
    return latest(stored.unionByName(gone), "p_partkey").where("active").select("p_partkey", "p_name")


@query("s12_sequential_ids", "SELECT count(*) AS n, count(*) AS distinct_ids, 101 AS low, 100 + count(*) AS high FROM supplier")
def ids(spark, d):
    numbered = sequential_ids(tables(spark, d, "supplier"), "Supplier", 100)
    n = F.substring_index("_id", "-", -1).cast("long")
    return numbered.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("distinct_ids"), F.min(n).cast("int").alias("low"), F.max(n).alias("high"))


@query("f8_policy_base", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def policy_base(spark, d):
    rules = [
        Policy("customer", "c_acctbal > 0"),
        Policy("customer", "c_mktsegment = upper(session.username)"),
        Policy("customer", "false", operations=("write",)),
    ]
    return allowed(tables(spark, d, "customer"), rules, "customer", Session("building")).select("c_custkey")


@query("f8_policy_for_others_denies", "SELECT c_mktsegment, false AS readable, true AS in_table FROM customer GROUP BY c_mktsegment")
def policy_for_others(spark, d):
    rules = [Policy("customer", "true"), Policy("customer", "true", group="nobody")]
    customer = tables(spark, d, "customer")
    read = allowed(customer, rules, "customer", Session("building")).groupBy(F.col("c_mktsegment").alias("s")).count()
    return customer.groupBy("c_mktsegment").count().join(read, F.col("c_mktsegment") == F.col("s"), "left").select(
        "c_mktsegment", F.col("s").isNotNull().alias("readable"), F.lit(True).alias("in_table"),
    )


@query("f10_policy_targeted", "SELECT c_custkey FROM customer WHERE c_nationkey = 4")
def policy_targeted(spark, d):
    rules = [Policy("customer", "false"), Policy("~customer", "c_nationkey = 4", group="four"), Policy("customer", "false", user="other")]
    return allowed(tables(spark, d, "customer"), rules, "customer", Session("ann", "u1", ("four",))).select("c_custkey")


@query("f8_policy_null_denies", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def policy_null(spark, d):
    return allowed(
        tables(spark, d, "orders"), [Policy("orders", "CASE WHEN o_totalprice > 100000 THEN true END")], "orders", Session("ann"),
    ).select("o_orderkey")


SECRET = ClassModel("customer", (Attribute("c_custkey", "integer"), Attribute("c_name", encrypted=True), Attribute("c_acctbal", "decimal", encrypted=True)))
KEY = bytes(range(32))


def _sealed(spark, d):
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    crypto.encrypt(tables(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), SECRET, KEY).write.parquet(path)
    return spark.read.parquet(path)


@query("f13_decrypt_with_key", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def with_key(spark, d):
    return crypto.decrypt(_sealed(spark, d), SECRET, KEY)


@query("f14_read_without_key", "SELECT c_custkey, NULL::VARCHAR AS c_name, NULL::DOUBLE AS c_acctbal FROM customer")
def without_key(spark, d):
    return crypto.decrypt(_sealed(spark, d), SECRET, None)


@query("f12_sealed_shape", "SELECT c_custkey, true AS sealed, 16 AS iv_length, 'AES-GCM' AS alg FROM customer")
def sealed_shape(spark, d):
    return _sealed(spark, d).select(
        "c_custkey", F.col("c_name.__enc").alias("sealed"), F.length("c_name.iv").alias("iv_length"), F.col("c_name.alg").alias("alg"),
    )


@query("f1_triggers", "SELECT o_orderkey, o_totalprice > 100000 AS big, o_totalprice * 2 AS gross FROM orders")
def triggers(spark, d):
    hooks = [
        Trigger("flag", "orders", sets={"big": "o_totalprice > 100000"}),
        Trigger("gross", "orders", run=lambda df: df.withColumn("gross", F.col("o_totalprice") * 2)),
        Trigger("nothing", "orders", run=lambda df: None),
    ]
    return apply_triggers(tables(spark, d, "orders"), hooks, "orders", "before").select("o_orderkey", "big", "gross")


def _event_stream(spark, d):
    return spark.readStream.schema(tables(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")


@query("r1_change_feed", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def change_feed(spark, d):
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    feed = _event_stream(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "value")
    replicate(feed, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/data/n={n}"), f"{path}/checkpoint", seconds=None).awaitTermination()
    return spark.read.parquet(f"{path}/data").select(*feed.columns)


@query(
    "r4_live_view",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND value > 20",
)
def live(spark, d):
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    feed = _event_stream(spark, d).select("user_id", "event_id", "value")
    running = live_view(feed, f"{path}/view", f"{path}/checkpoint", F.col("value") > 20, "user_id", "event_id")
    running.awaitTermination()
    return current(spark, f"{path}/view", last_batch(running))


@query("r8_windowed_counts", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, d):
    counts = windowed_counts(tables(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", "event_type")
    return counts.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "event_type", "n")
