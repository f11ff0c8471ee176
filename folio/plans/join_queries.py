"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators.joins import array_join, keyed_array_match, relation_join
from folio.plans.registry import query, tables
from folio.plans.scan_queries import BASKET, _sql, baskets

SMALL = "(SELECT p_partkey, p_name FROM part WHERE p_size <= 5)"


def small_parts(spark, d):
    return tables(spark, d, "part").where("p_size <= 5").select("p_partkey", "p_name")


@query("j1_array_inner", f"SELECT l_orderkey, p_partkey, p_name FROM (SELECT l_orderkey, unnest(parts) AS item FROM {BASKET}) JOIN {SMALL} ON item = p_partkey")
def array_inner(spark, d):
    return array_join(baskets(spark, d), small_parts(spark, d), "parts", "p_partkey").select("l_orderkey", "p_partkey", "p_name")


LONELY = f"SELECT l_orderkey, NULL::BIGINT, NULL::VARCHAR FROM {BASKET} WHERE NOT list_has_any(parts, (SELECT list(p_partkey) FROM {SMALL}))"


@query(
    "j2_array_left",
    f"SELECT l_orderkey, p_partkey, p_name FROM (SELECT l_orderkey, unnest(parts) AS item FROM {BASKET}) JOIN {SMALL} ON item = p_partkey UNION ALL {LONELY}",
)
def array_left(spark, d):
    return array_join(baskets(spark, d), small_parts(spark, d), "parts", "p_partkey", "left").select("l_orderkey", "p_partkey", "p_name")


LARGE = "(SELECT l_orderkey, list(l_partkey) AS parts FROM lineitem WHERE l_quantity >= 50 GROUP BY l_orderkey)"


def large_baskets(spark, d):
    """Orders with the array of the parts of their largest lines."""
    return tables(spark, d, "lineitem").where("l_quantity >= 50").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))


@query(
    "j3_array_right",
    f"WITH b AS (SELECT * FROM {LARGE}) SELECT l_orderkey, p_partkey, p_name FROM (SELECT l_orderkey, unnest(parts) AS item FROM b) JOIN {SMALL} ON item = p_partkey "
    f"UNION ALL SELECT NULL, p_partkey, p_name FROM {SMALL} WHERE p_partkey NOT IN (SELECT unnest(parts) FROM b)",
)
def array_right(spark, d):
    return array_join(large_baskets(spark, d), small_parts(spark, d), "parts", "p_partkey", "right").select("l_orderkey", "p_partkey", "p_name")


@query(
    "j4_join_chain",
    f"SELECT b.l_orderkey, p_name, c_name FROM (SELECT l_orderkey, unnest(parts) AS item FROM {BASKET}) b JOIN {SMALL} ON item = p_partkey JOIN orders ON o_orderkey = b.l_orderkey JOIN customer ON c_custkey = o_custkey",
)
def chain(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    first = array_join(baskets(spark, d), small_parts(spark, d), "parts", "p_partkey")
    return first.join(orders, first.l_orderkey == orders.o_orderkey).join(customer, F.col("c_custkey") == F.col("o_custkey")).select("l_orderkey", "p_name", "c_name")


@query("j5_array_semi", f"SELECT l_orderkey FROM {BASKET} WHERE list_has_any(parts, (SELECT list(p_partkey) FROM {SMALL}))")
def array_semi(spark, d):
    return keyed_array_match(baskets(spark, d), small_parts(spark, d), "parts", ["l_orderkey"], "p_partkey").select("l_orderkey")


@query("j6_array_anti", f"SELECT l_orderkey FROM {BASKET} WHERE NOT list_has_any(parts, (SELECT list(p_partkey) FROM {SMALL}))")
def array_anti(spark, d):
    return keyed_array_match(baskets(spark, d), small_parts(spark, d), "parts", ["l_orderkey"], "p_partkey", negate=True).select("l_orderkey")


@query("j5_array_semi_any_rows", f"SELECT l_orderkey FROM {BASKET} WHERE list_has_any(parts, (SELECT list(p_partkey) FROM {SMALL}))")
def array_semi_rows(spark, d):
    return array_join(baskets(spark, d), small_parts(spark, d), "parts", "p_partkey", "semi").select("l_orderkey")


@query("j6_array_anti_any_rows", f"SELECT l_orderkey FROM {BASKET} WHERE NOT list_has_any(parts, (SELECT list(p_partkey) FROM {SMALL}))")
def array_anti_rows(spark, d):
    return array_join(baskets(spark, d), small_parts(spark, d), "parts", "p_partkey", "anti").select("l_orderkey")


@query("j5_inner_side_array_semi", f"SELECT p_partkey FROM part WHERE p_partkey IN (SELECT unnest(parts) FROM {LARGE})")
def named_parts(spark, d):
    named = large_baskets(spark, d).select(F.explode("parts").alias("item"))
    part = tables(spark, d, "part")
    return part.join(named, part.p_partkey == named["item"], "left_semi").select("p_partkey")


_sql("j7_semi_equi", "SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
_sql(
    "j7_anti_equi",
    "SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
)
_sql("j8_inner_equi", "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey")
_sql("j8_left_equi", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000")
_sql("j8_right_equi", "SELECT s.s_suppkey, n.n_name FROM supplier AS s RIGHT JOIN nation AS n ON s.s_nationkey = n.n_nationkey")
_sql(
    "j9_null_extended",
    "SELECT c.c_custkey FROM customer AS c LEFT JOIN orders AS o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000 WHERE o.o_orderkey IS NULL",
)
_sql(
    "j11_self_join",
    "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)


@query("j10_relation_join", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def by_relation(spark, d):
    region, nation = tables(spark, d, "region", "nation")
    edges = nation.select(F.col("n_regionkey").alias("sourceId"), F.col("n_nationkey").alias("targetId"))
    return relation_join(region, edges, nation, "r_regionkey", "n_nationkey").select("r_name", "n_name")


_sql("qa_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
_sql(
    "qb_correlated_scalar",
    "SELECT o.o_orderkey FROM orders AS o WHERE o.o_totalprice >= (SELECT MAX(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)",
)
_sql(
    "qc_exists_many_predicates",
    "SELECT s_suppkey FROM supplier AS s WHERE EXISTS (SELECT 1 FROM customer AS c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal)",
)
_sql("qd_uncorrelated_exists", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 2)")
_sql(
    "qe_filtered_aggregate",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT MAX(o_totalprice) FROM orders WHERE o_orderstatus = 'F')",
)


@query(
    "qb_correlated_array_scalar", f"SELECT l_orderkey, (SELECT max(p_retailprice) FROM part WHERE list_contains(b.parts, p_partkey)) AS dearest FROM {BASKET} b",
)
def dearest_part(spark, d):
    # a correlated array predicate compares all pairs; the array join groups to the same
    part = tables(spark, d, "part").select("p_partkey", "p_retailprice")
    b = baskets(spark, d)
    found = array_join(b, part, "parts", "p_partkey").groupBy("l_orderkey").agg(F.max("p_retailprice").alias("dearest"))
    return b.select("l_orderkey").join(found, "l_orderkey", "left")
