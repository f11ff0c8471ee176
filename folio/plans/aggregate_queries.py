"""Aggregation, order, distinct and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators.rows import distinct_on, duplicates, union
from folio.plans.registry import query, tables
from folio.plans.scan_queries import _sql

_sql("a1_count_star", "SELECT COUNT(*) AS n FROM lineitem")
_sql("a2_count_column", "SELECT COUNT(CASE WHEN l_quantity > 25 THEN l_quantity END) AS n FROM lineitem")
_sql("a3_count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders")
_sql("a4_sum", "SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
_sql("a5_avg", "SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
_sql("a6_min_max", "SELECT c_mktsegment, MIN(c_name) AS first_name, MAX(c_acctbal) AS top FROM customer GROUP BY c_mktsegment")
_sql(
    "a7_distinct_aggregates",
    "SELECT SUM(DISTINCT p_size) AS total, AVG(DISTINCT p_size) AS mean, MIN(DISTINCT p_size) AS low, MAX(DISTINCT p_size) AS high FROM part",
    "SELECT SUM(DISTINCT p_size)::BIGINT AS total, AVG(DISTINCT p_size) AS mean, MIN(DISTINCT p_size) AS low, MAX(DISTINCT p_size) AS high FROM part",
)
_sql(
    "a9_group_by_many",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
_sql(
    "a9_null_group",
    "SELECT CASE WHEN l_quantity > 25 THEN l_returnflag END AS flag, COUNT(*) AS n FROM lineitem GROUP BY CASE WHEN l_quantity > 25 THEN l_returnflag END",
)
_sql("a10_global_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, MAX(o_orderstatus) AS top FROM orders WHERE o_orderkey < 0")
_sql("a11_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15 AND MAX(o_totalprice) > 100000")
_sql("a13_star_distinct_count", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")


@query("a14_default_names", "SELECT o_orderpriority, COUNT(*) AS \"COUNT\" FROM orders GROUP BY o_orderpriority")
def default_names(spark, d):
    return tables(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("COUNT"))


@query("a15_duplicate_keys", "SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING COUNT(*) > 1")
def duplicate_keys(spark, d):
    return duplicates(tables(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


_sql("o1_order_by_many", "SELECT c_nationkey, c_name FROM customer ORDER BY c_nationkey DESC, c_name")
_sql("o2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_sql("o2_limit_zero", "SELECT n_name FROM nation LIMIT 0")
_sql("o3_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 25")
_sql("d1_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_sql("d2_order_then_limit_distinct", "SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 7")


@query(
    "d3_distinct_on",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def first_of_each(spark, d):
    return distinct_on(tables(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"])


def _keys(spark, d):
    c, s = tables(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nation")), s.select(F.col("s_nationkey").alias("nation"))


@query("u1_union_all", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return union(list(_keys(spark, d)), distinct=False)


@query("u2_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return union(list(_keys(spark, d)))


@query("u3_union_chain", "(SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT n_regionkey FROM nation")
def union_chain(spark, d):
    return union([*_keys(spark, d), tables(spark, d, "nation").select(F.col("n_regionkey").alias("nation"))], [True, False])


@query(
    "u4_union_order_limit",
    "SELECT nation FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY nation DESC LIMIT 5",
)
def union_page(spark, d):
    return union(list(_keys(spark, d)), order=["-nation"], limit=5)


@query("u1_union_by_name", "SELECT n_name AS name, n_nationkey AS id FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def union_by_name(spark, d):
    n, r = tables(spark, d, "nation", "region")
    return union(
        [n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))],
        distinct=False,
    )
