"""The same tables as classes of a stack: written, changed, deleted and read through it, with policies, relations and encryption."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.hooks import Trigger
from folio.operators.policies import Policy, Session
from folio.operators.relations import Domain
from folio.plans.registry import query, tables
from folio.sources.documents import DocumentLog
from folio.sources.schema import Attribute, ClassModel
from folio.sources.stack import Stack
from folio.sources.store import scratch
from folio.streaming.feeds import change_feed, current, into_log, last_batch, live_view, replicate

CUSTOMER = ClassModel(
    "Customer", (Attribute("name", mandatory=True), Attribute("segment", mandatory=True), Attribute("balance", "decimal"), Attribute("phone", encrypted=True)),
)
ORDER = ClassModel(
    "Purchase",
    (
        Attribute("customer", "foreign_key", target="Customer", mandatory=True),
        Attribute("price", "decimal", min=0),
        Attribute("status", "enum", values=("F", "O", "P")),
    ),
)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "customer").select(
        F.format_string("Customer-%d", "c_custkey").alias("_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.format_string("phone %d", "c_custkey").alias("phone"),
    )


def purchases(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "orders").select(
        F.format_string("Purchase-%d", "o_orderkey").alias("_id"),
        F.format_string("Customer-%d", "o_custkey").alias("customer"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )


def stack_of(spark: SparkSession, d: str, orders: bool = False, **how) -> Stack:
    """A stack in the shared folder that holds the customers, and the orders if asked for."""
    stack = Stack(spark, f"{scratch(spark)}/{uuid.uuid4().hex}", **how)
    stack.create_class(CUSTOMER)
    stack.create_class(ORDER)
    stack.write("Customer", customers(spark, d))
    if orders:
        stack.write("Purchase", purchases(spark, d))
    return stack


ID = "'Customer-' || c_custkey"


@query("stack_scan", f"SELECT {ID} AS _id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def scan(spark, d):
    return stack_of(spark, d).scan("Customer").select("_id", "name", "segment", "balance")


@query(
    "stack_find_page",
    f"SELECT {ID} AS _id, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 ORDER BY c_acctbal DESC, _id LIMIT 20 OFFSET 10",
)
def find_page(spark, d):
    return stack_of(spark, d).find(
        "Customer", {"segment": "BUILDING", "balance": {"$gt": 1000}}, fields=["_id", "balance"], sort=["-balance", "_id"], skip=10, limit=20,
    )


@query("stack_get", f"SELECT {ID} AS _id, c_name AS name FROM customer WHERE c_custkey IN (3, 14, 15)")
def get(spark, d):
    return stack_of(spark, d).get("Customer", "Customer-3", "Customer-14", "Customer-15", "Customer-999999999").select("_id", "name")


@query(
    "stack_sql_join",
    "SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS dearest FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 AND o_orderstatus = 'F' GROUP BY 1",
)
def sql_join(spark, d):
    stack = stack_of(spark, d, orders=True)
    return stack.sql(
        "SELECT c.segment, COUNT(*) AS n, MAX(p.price) AS dearest FROM Purchase AS p JOIN Customer AS c ON p.customer = c._id WHERE p.price > ? AND p.status = ? GROUP BY c.segment",
        50000,
        "F",
    )


@query(
    "stack_update_and_delete",
    f"SELECT {ID} AS _id, c_mktsegment AS segment, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer WHERE c_acctbal >= 0",
)
def update_and_delete(spark, d):
    stack = stack_of(spark, d)
    stack.write("Customer", stack.scan("Customer").where("segment = 'MACHINERY'").select("_id", (F.col("balance") + 1).alias("balance")))
    stack.delete("Customer", customers(spark, d).where("balance < 0").select("_id"))
    return stack.scan("Customer").select("_id", "segment", "balance")


@query("stack_compacted", f"SELECT {ID} AS _id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.0 ELSE c_acctbal END AS balance FROM customer")
def compacted(spark, d):
    stack = stack_of(spark, d)
    stack.write("Customer", stack.scan("Customer").where("segment = 'MACHINERY'").select("_id", F.lit(0.0).alias("balance")))
    stack.compact("Customer")
    return stack.scan("Customer").select("_id", "balance")


@query("stack_push_by_key", "SELECT n_name AS name, CASE WHEN n_regionkey = 2 THEN 'two' ELSE 'other' END AS note FROM nation")
def push(spark, d):
    stack = Stack(spark, f"{scratch(spark)}/{uuid.uuid4().hex}")
    stack.create_class(ClassModel("Nation", (Attribute("name", primary_key=True, mandatory=True), Attribute("note"))))
    nation = tables(spark, d, "nation")
    stack.write("Nation", nation.where("n_regionkey <= 2").select(F.col("n_name").alias("name"), F.lit("old").alias("note")))
    stack.push("Nation", nation.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, "two").otherwise("other").alias("note")))
    return stack.scan("Nation").select("name", "note")


@query(
    "stack_policies_in_subqueries",
    f"SELECT {ID} AS _id, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) AS all_mine FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
)
def policies(spark, d):
    stack = stack_of(spark, d)
    stack.policies += [Policy("Customer", "balance > 0"), Policy("Customer", "segment = upper(session.username)", operations=("read",))]
    stack.session = Session("building")
    return stack.sql("SELECT _id, (SELECT COUNT(*) FROM Customer) AS all_mine FROM Customer WHERE balance > :least", least=5000)


@query("stack_decrypts", f"SELECT {ID} AS _id, 'phone ' || c_custkey AS phone FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
def decrypts(spark, d):
    stack = stack_of(spark, d, key=bytes(range(32)), encrypts=True)
    return stack.find("Customer", {"segment": "AUTOMOBILE"}, fields=["_id", "phone"])


@query("stack_keyless_read", f"SELECT {ID} AS _id, NULL::VARCHAR AS phone FROM customer")
def keyless(spark, d):
    stack = stack_of(spark, d, key=bytes(range(32)), encrypts=True)
    stack.key = None
    return stack.scan("Customer").select("_id", "phone")


@query("stack_triggers", f"SELECT {ID} AS _id, upper(c_name) AS name, round(c_acctbal * 2, 2) AS balance FROM customer")
def triggers(spark, d):
    stack = Stack(spark, f"{scratch(spark)}/{uuid.uuid4().hex}")
    stack.create_class(CUSTOMER)
    stack.triggers += [
        Trigger("upper", "Customer", sets={"name": "upper(name)"}),
        Trigger("double", "Customer", "after", sets={"balance": "round(balance * 2, 2)"}),
    ]
    stack.write("Customer", customers(spark, d))
    return stack.scan("Customer").select("_id", "name", "balance")


@query("stack_related", f"SELECT c_name AS customer, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def related(spark, d):
    stack = stack_of(spark, d, orders=True)
    stack.create_domain(Domain("buys", "1:N", "Customer", "Purchase"))
    stack.relate("buys", purchases(spark, d).select(F.col("customer").alias("sourceId"), F.col("_id").alias("targetId")))
    return stack.related("buys").where("target.status = 'P'").select(F.col("source.name").alias("customer"), F.col("target.price").alias("price"))


@query("stack_replicated", f"SELECT {ID} AS _id, c_acctbal + (CASE WHEN c_nationkey = 5 THEN 10 ELSE 0 END) AS balance FROM customer")
def replicated(spark, d):
    stack = stack_of(spark, d)
    stack.write(
        "Customer",
        tables(spark, d, "customer").where("c_nationkey = 5").select(
            F.format_string("Customer-%d", "c_custkey").alias("_id"), (F.col("c_acctbal") + 10).alias("balance"),
        ),
    )
    place = f"{scratch(spark)}/{uuid.uuid4().hex}"
    remote = DocumentLog(spark, place, CUSTOMER)
    replicate(change_feed(spark, f"{stack.path}/Customer", CUSTOMER.struct()), into_log(remote), f"{place}/checkpoint", seconds=None).awaitTermination()
    return remote.documents().select("_id", "balance")


@query("stack_live_result", f"SELECT {ID} AS _id, c_acctbal AS balance FROM customer WHERE c_acctbal > 3000 AND c_mktsegment <> 'FURNITURE'")
def live(spark, d):
    stack, place = stack_of(spark, d), f"{scratch(spark)}/{uuid.uuid4().hex}"
    watch = lambda: live_view(change_feed(spark, f"{stack.path}/Customer", CUSTOMER.struct()), f"{place}/view", f"{place}/checkpoint", F.col("balance") > 3000)
    watch().awaitTermination()
    stack.delete("Customer", customers(spark, d).where("segment = 'FURNITURE'").select("_id"))
    second = watch()
    second.awaitTermination()
    return current(spark, f"{place}/view", last_batch(second)).select("_id", "balance")


@query(
    "s8_model_search",
    "SELECT name FROM (VALUES ('Customer', 'buyers'), ('Purchase', 'orders of customers'), ('Item', 'what is sold')) AS t(name, about) WHERE name ILIKE '%custom%' OR about ILIKE '%custom%'",
)
def model_search(spark, d):
    stack = Stack(spark, f"{scratch(spark)}/{uuid.uuid4().hex}")
    for name, about in (("Customer", "buyers"), ("Purchase", "orders of customers"), ("Item", "what is sold")):
        stack.create_class(ClassModel(name, (Attribute("x"),), about))
    return spark.createDataFrame([(m.name,) for m in stack.models(search="custom")], "name string")


@query("a8_count_distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM nation)")
def count_distinct_rows(spark, d):
    return tables(spark, d, "nation").unionByName(tables(spark, d, "nation")).select(F.expr("count(DISTINCT *)").alias("n"))
