"""Scans, selectors, projections and predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.functions.selectors import find
from folio.functions.values import changed_fields, content_hash, version_key
from folio.plans.registry import query, run_sql, tables
from folio.sources import files
from folio.sources.store import scratch


@query("s1_class_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def class_scan(spark, d):
    return files.class_table(spark, d, "customer")


@query("s2_find_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def find_page(spark, d):
    return find(tables(spark, d, "orders"), {"o_orderstatus": "O", "o_totalprice": {"$gt": 100000}}, ["o_orderkey", "o_totalprice"], ["o_orderkey"], 10, 20)


@query("s3_find_one", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def find_one(spark, d):
    return find(tables(spark, d, "customer"), {"c_mktsegment": "BUILDING"}, ["c_custkey", "c_name"], ["c_custkey"], limit=1)


@query("s4_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return find(tables(spark, d, "customer"), {"c_custkey": 42})


@query("s5_multi_get", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 7, 11, 1000000)")
def multi_get(spark, d):
    return find(tables(spark, d, "part"), {"p_partkey": {"$in": [3, 7, 11, 1000000]}}, ["p_partkey", "p_name"])


@query("s6_table_scan_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_totalprice <= 250000")
def table_scan_filter(spark, d):
    return run_sql(spark, d, "SELECT o_orderkey, o_totalprice FROM orders AS o WHERE o.o_totalprice >= 200000 AND o.o_totalprice <= 250000")


def _round_trip(spark, d, kind, name, schema):
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    files.export(tables(spark, d, name), path, kind)
    return files.read(spark, path, kind, schema)


@query("s10_export_json", "SELECT * FROM supplier")
def export_json(spark, d):
    return _round_trip(spark, d, "json", "supplier", tables(spark, d, "supplier").schema)


@query("s16_adapter_csv", "SELECT * FROM part")
def adapter_csv(spark, d):
    return _round_trip(spark, d, "csv", "part", tables(spark, d, "part").schema)


@query("s16_adapter_parquet", "SELECT * FROM nation")
def adapter_parquet(spark, d):
    return _round_trip(spark, d, "parquet", "nation", None)


def _selector(name, table, condition, fields, where):
    @query(name, f"SELECT {', '.join(fields)} FROM {table} WHERE {where}")
    def run(spark, d):
        return find(tables(spark, d, table), condition, fields)


_selector("sel_eq", "customer", {"c_mktsegment": "MACHINERY"}, ["c_custkey"], "c_mktsegment = 'MACHINERY'")
_selector("sel_ne", "customer", {"c_mktsegment": {"$ne": "MACHINERY"}}, ["c_custkey"], "c_mktsegment <> 'MACHINERY'")
_selector(
    "sel_range", "lineitem", {"l_quantity": {"$gte": 10, "$lt": 20}}, ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity >= 10 AND l_quantity < 20",
)
_selector(
    "sel_in_nin",
    "orders",
    {"o_orderstatus": {"$in": ["F", "O"]}, "o_custkey": {"$nin": [1, 2, 3]}},
    ["o_orderkey"],
    "o_orderstatus IN ('F', 'O') AND o_custkey NOT IN (1, 2, 3)",
)
_selector("sel_exists", "documents", {"text": {"$exists": True}}, ["doc_id"], "text IS NOT NULL")
_selector("sel_type", "part", {"p_size": {"$type": "number"}, "p_name": {"$type": "string"}}, ["p_partkey"], "p_size IS NOT NULL AND p_name IS NOT NULL")
_selector("sel_regex", "part", {"p_name": {"$regex": "^(small|red) .*t$"}}, ["p_partkey", "p_name"], "regexp_matches(p_name, '^(small|red) .*t$')")
_selector("sel_mod", "part", {"p_partkey": {"$mod": [7, 3]}}, ["p_partkey"], "p_partkey % 7 = 3")
_selector(
    "sel_and_or",
    "orders",
    {"$and": [{"$or": [{"o_orderstatus": "F"}, {"o_totalprice": {"$lt": 5000}}]}, {"o_custkey": {"$gt": 100}}]},
    ["o_orderkey"],
    "(o_orderstatus = 'F' OR o_totalprice < 5000) AND o_custkey > 100",
)
_selector(
    "sel_not_nor",
    "customer",
    {"$nor": [{"c_nationkey": 3}, {"c_acctbal": {"$lt": 0}}], "c_custkey": {"$not": {"$lt": 50}}},
    ["c_custkey"],
    "NOT (c_nationkey = 3 OR c_acctbal < 0) AND NOT (c_custkey < 50)",
)

BASKET = "(SELECT l_orderkey, list(l_partkey) AS parts FROM lineitem GROUP BY l_orderkey)"


def baskets(spark, d):
    """Orders with the array of their parts' ids, duplicates kept."""
    return tables(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))


def _array_selector(name, condition, where):
    @query(name, f"SELECT l_orderkey FROM {BASKET} WHERE {where}")
    def run(spark, d):
        return find(baskets(spark, d), condition, ["l_orderkey"])


_array_selector("sel_size", {"parts": {"$size": 3}}, "len(parts) = 3")
_array_selector("sel_all", {"parts": {"$all": [5]}}, "list_has_all(parts, [5])")
_array_selector("sel_elem_match", {"parts": {"$elemMatch": {"$gt": 20, "$lt": 25}}}, "len(list_filter(parts, lambda x: x > 20 AND x < 25)) > 0")
_array_selector("sel_all_match", {"parts": {"$allMatch": {"$gt": 100}}}, "len(parts) > 0 AND len(list_filter(parts, lambda x: x > 100)) = len(parts)")


@query("sel_dotted", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def dotted(spark, d):
    events = tables(spark, d, "events").withColumn("p", F.from_json("props", "k BIGINT"))
    return find(events, {"p.k": {"$gte": 50}}, ["event_id"])


def _sql(name, text, oracle=None, **args):
    @query(name, oracle or text)
    def run(spark, d):
        return run_sql(spark, d, text, **args)


_sql("p1_projection_alias", "SELECT c_custkey AS id, c_name AS name FROM customer")
_sql("p2_qualified_columns", "SELECT c.c_custkey, n.n_name FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey")
_sql("p3_star", "SELECT * FROM region")
_sql("p4_scalar_subquery_item", "SELECT n_name, (SELECT COUNT(*) FROM customer AS c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation AS n")
_sql("p5_comparisons", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02 AND l_tax >= 0.05 AND l_linenumber < 4")
_sql("p7_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
_sql("p8_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
_sql("p9_conjunction", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 30 AND p_retailprice > 905 AND p_partkey > 5")
_sql("p12_column_to_column", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
_sql("p13_or_like_between", "SELECT p_partkey FROM part WHERE (p_name LIKE '%1%' OR p_size BETWEEN 5 AND 9) AND p_brand <> 'Brand#1'")
_sql(
    "p14_case_cast_null",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size_class, CAST(o_custkey AS VARCHAR(20)) AS cust, o_orderpriority IS NULL AS no_priority FROM orders",
)
_sql(
    "p15_parameters",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'",
    least=150000,
    status="F",
)


@query("p6_array_membership", f"SELECT l_orderkey FROM {BASKET} WHERE list_contains(parts, 17)")
def array_membership(spark, d):
    return baskets(spark, d).where(F.coalesce(F.array_contains("parts", 17), F.lit(False))).select("l_orderkey")


@query("p8_not_in_array", f"SELECT l_orderkey FROM {BASKET} WHERE NOT list_contains(parts, 17)")
def not_in_array(spark, d):
    return baskets(spark, d).where(~F.coalesce(F.array_contains("parts", 17), F.lit(False))).select("l_orderkey")


@query("fn_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def hashes(spark, d):
    return tables(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


@query("fn_version_order", "SELECT l_orderkey, l_linenumber, l_linenumber * 1000000 + (l_partkey % 50) * 1000 + l_suppkey % 20 AS rank FROM lineitem")
def versions(spark, d):
    v = version_key(F.concat_ws(".", "l_linenumber", (F.col("l_partkey") % 50), F.concat((F.col("l_suppkey") % 20).cast("string"), F.lit("-rc1"))))
    return tables(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (v[0] * 1000000 + v[1] * 1000 + v[2]).alias("rank"))


@query("fn_document_diff", "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN 'n_regionkey' ELSE '' END AS changed FROM nation")
def diff(spark, d):
    n = tables(spark, d, "nation")
    old, new = F.struct("n_name", "n_regionkey"), F.struct("n_name", F.lit(1).alias("n_regionkey"))
    return n.select("n_nationkey", F.array_join(changed_fields(old, new, ["n_name", "n_regionkey"]), ",").alias("changed"))
