"""All registered queries of the core library, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.plans import aggregate_queries, document_queries, join_queries, scan_queries, stack_queries  # noqa: F401  they register themselves
from folio.plans.registry import ORACLE, QUERIES, query, run_sql

FLAGSHIP = """SELECT c.c_mktsegment AS segment, COUNT(*) AS n_orders, MAX(o.o_totalprice) AS max_price
FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice > 50000 GROUP BY c.c_mktsegment HAVING COUNT(*) > 5 ORDER BY n_orders DESC, segment LIMIT 10"""


@query("flagship", FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, FLAGSHIP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
