"""Writes, versions, relations, policies, encryption, hooks, patches and feeds."""

import pytest
from pyspark.sql import functions as F

from folio.functions.selectors import find
from folio.functions.values import derived_key
from folio.operators.hooks import Job, JobRun, Jobs, JobSkipped, Trigger
from folio.operators.patches import Patch, pending
from folio.operators.policies import NotAuthenticated, Policy, Session
from folio.operators.relations import Domain
from folio.operators.validation import ValidationError
from folio.sources.schema import Attribute, ClassModel, entity_diagram
from folio.sources.stack import Stack
from folio.sources.documents import DocumentLog
from folio.streaming.feeds import MODELS, change_feed, current, into_log, last_batch, live_models, live_view, model_changes, replicate


@pytest.fixture
def stack(spark, tmp_path):
    return Stack(spark, str(tmp_path / "stack"))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ids_upsert_delete_history(spark, stack):
    stack.create_class(ClassModel("Card", (Attribute("title", mandatory=True), Attribute("pages", "integer", min=1))))
    stack.write("Card", frame(spark, [("a", 1), ("b", 2)], "title string, pages long"))
    stack.write("Card", frame(spark, [("c", 3)], "title string, pages long"))
    assert sorted(r._id for r in stack.scan("Card").collect()) == ["Card-1", "Card-2", "Card-3"]
    stack.write("Card", frame(spark, [("Card-2", 20)], "_id string, pages long"))
    assert [(r.title, r.pages) for r in stack.get("Card", "Card-2").collect()] == [("b", 20)]
    stack.delete("Card", frame(spark, [("Card-1",)], "_id string"))
    assert sorted(r.title for r in stack.scan("Card").collect()) == ["b", "c"]
    assert sorted(r.title for r in stack.scan("Card", inactive=True).collect()) == ["a", "b", "c"]
    assert [r.title for r in stack.find("Card", {"pages": {"$gt": 1}}, fields=["title"], sort=["-pages"], limit=1).collect()] == ["b"]
    assert stack.find_one("Card").count() == 1


@pytest.mark.parametrize(("row", "rule"), [((None, 1), "title.mandatory"), (("x", 0), "pages.min"), (("long title", 1), "title.max_length")])
def test_validation_rejects_the_call(spark, stack, row, rule):
    stack.create_class(ClassModel("Card", (Attribute("title", mandatory=True, max_length=5), Attribute("pages", "integer", min=1))))
    with pytest.raises(ValidationError, match=rule):
        stack.write("Card", frame(spark, [("ok", 1), row], "title string, pages long"))
    assert stack.scan("Card").count() == 0


def test_enum_key_and_foreign_key(spark, stack):
    stack.create_class(ClassModel("EnumDoc", (Attribute("status", "enum", values=("OPEN", "CLOSED"), mandatory=True, primary_key=True),)))
    stack.create_class(ClassModel("Link", (Attribute("to", "foreign_key", target="EnumDoc"),)))
    with pytest.raises(ValidationError, match="enum"):
        stack.write("EnumDoc", frame(spark, [("HALF",)], "status string"))
    stack.write("EnumDoc", frame(spark, [("OPEN",)], "status string"))
    with pytest.raises(ValidationError, match="duplicate"):
        stack.write("EnumDoc", frame(spark, [("OPEN",)], "status string"))
    stack.push("EnumDoc", frame(spark, [("OPEN",), ("CLOSED",)], "status string"))
    assert stack.scan("EnumDoc").count() == 2
    stack.write("Link", frame(spark, [("EnumDoc-1",)], "to string"))
    with pytest.raises(ValueError, match="no such EnumDoc"):
        stack.write("Link", frame(spark, [("EnumDoc-9",)], "to string"))
    with pytest.raises(ValueError, match="no values"):
        Attribute("e", "enum")


def test_relations(spark, stack):
    stack.create_class(ClassModel("Customer", (Attribute("name"),)))
    stack.create_class(ClassModel("Account", (Attribute("no"), Attribute("customer", "reference", domain="owns"))))
    stack.create_domain(Domain("owns", "1:N", "Customer", "Account"))
    stack.write("Customer", frame(spark, [("ann",), ("bob",)], "name string"))
    stack.write("Account", frame(spark, [("n1", "Customer-1"), ("n2", "Customer-1")], "no string, customer string"))
    assert stack.edges("owns").count() == 2
    assert sorted((r.source.name, r.target.no) for r in stack.related("owns").collect()) == [("ann", "n1"), ("ann", "n2")]
    stack.relate("owns", frame(spark, [("Customer-1", "Account-1")], "sourceId string, targetId string"))
    assert stack.edges("owns").count() == 2
    with pytest.raises(ValueError, match="cardinality"):
        stack.relate("owns", frame(spark, [("Customer-2", "Account-1")], "sourceId string, targetId string"))
    with pytest.raises(ValueError, match="missing"):
        stack.relate("owns", frame(spark, [("Customer-2", "Account-7")], "sourceId string, targetId string"))
    stack.unrelate("owns", frame(spark, [("Customer-1", "Account-1"), ("Customer-1", "Account-2")], "sourceId string, targetId string"))
    assert stack.edges("owns").count() == 0
    with pytest.raises(ValueError, match="can't hold"):
        Domain("owns", "1:N", "Customer", "Account").reference_side("Customer")
    assert "Customer ||--o{ Account : owns" in entity_diagram(list(stack.classes.values()), list(stack.domains.values()))


def test_policies(spark, stack):
    stack.create_class(ClassModel("Note", (Attribute("title"), Attribute("owner"))))
    stack.write("Note", frame(spark, [("a", "ann"), ("b", "bob"), ("c", None)], "title string, owner string"))
    stack.policies.append(Policy("Note", "owner = session.username"))
    with pytest.raises(NotAuthenticated, match="authenticated"):
        stack.sql("SELECT * FROM Note")
    stack.session = Session("ann")
    assert [r.title for r in stack.sql("SELECT title FROM Note").collect()] == ["a"]
    assert stack.sql("SELECT (SELECT COUNT(*) FROM Note) AS n").first().n == 1
    with pytest.raises(PermissionError):
        stack.write("Note", frame(spark, [("d", "bob")], "title string, owner string"))
    stack.policies.append(Policy("Note", "true", group="extra"))
    stack.session = Session("eve", groups=("extra",))
    assert stack.scan("Note").count() == 3


def test_targeted_policies_shut_out_all_others(spark, stack):
    stack.create_class(ClassModel("Note", (Attribute("title"), Attribute("owner"))))
    stack.write("Note", frame(spark, [("a", "ann"), ("b", "bob")], "title string, owner string"))
    stack.policies += [Policy("Note", "true"), Policy("Note", "owner = session.username", group="extra")]
    stack.session = Session("ann")
    assert stack.scan("Note").count() == 0
    with pytest.raises(PermissionError):
        stack.write("Note", frame(spark, [("c", "ann")], "title string, owner string"))
    stack.session = Session("ann", groups=("extra",))
    assert [r.title for r in stack.scan("Note").collect()] == ["a"]
    with pytest.raises(PermissionError):
        stack.delete("Note", frame(spark, [("Note-1",), ("Note-2",)], "_id string"))
    stack.delete("Note", frame(spark, [("Note-1",)], "_id string"))
    stack.policies.clear()
    assert [r.title for r in stack.scan("Note").collect()] == ["b"]
    with pytest.raises(ValueError, match="session"):
        stack.create_class(ClassModel("Bad", (Attribute("session"),)))


def test_sql_reads_classes_and_nothing_else(spark, stack, tmp_path):
    stack.create_class(ClassModel("Note", (Attribute("title"), Attribute("year", "integer"))))
    stack.create_class(ClassModel("My Notes", (Attribute("title"),)))
    stack.write("Note", frame(spark, [("a", 1), ("b", 7)], "title string, year long"))
    stack.write("My Notes", frame(spark, [("c",)], "title string"))
    spark.range(1).createOrReplaceTempView("others")
    for text in (
        f"SELECT * FROM parquet.`{stack.path}/Note`", f"SELECT (SELECT max(title) FROM parquet.`{stack.path}/Note`) AS x", "SELECT * FROM others", "SELECT * FROM Note WHERE title IN (SELECT id FROM others)", "DROP VIEW Note", "CREATE TABLE t AS SELECT * FROM Note",
        "INSERT INTO Note SELECT * FROM Note", "SET spark.sql.runSQLOnFiles=true", f"WITH n AS (SELECT * FROM csv.`{tmp_path}`) SELECT * FROM n", "SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT Title FROM Note JOIN default.Note", "ADD JAR 'x'", "SELECT * FROM Nothing",
    ):
        with pytest.raises(PermissionError):
            stack.sql(text)
    assert [r.title for r in stack.sql("WITH n AS (SELECT title FROM Note WHERE year > ?) SELECT title FROM n", 5).collect()] == ["b"]
    assert stack.sql("SELECT title FROM note UNION ALL SELECT title FROM \"My Notes\"").count() == 3
    assert stack.sql("SELECT title FROM Note WHERE year = :y", y=1).first().title == "a"
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_reads_push_filters_and_shuffle_nothing(spark, stack):
    stack.create_class(ClassModel("Note", (Attribute("title"), Attribute("year", "integer"), Attribute("owner"))))
    stack.write("Note", frame(spark, [(f"t{i}", i, "ann") for i in range(50)], "title string, year long, owner string"))
    stack.policies.append(Policy("Note", "owner = session.username"))
    stack.session = Session("ann")
    read = lambda: stack.sql("SELECT title FROM Note WHERE year > 45")
    plan = plan_of(read())
    assert "GreaterThan(year,45)" in plan and "EqualTo(owner,ann)" in plan and "Exchange" not in plan and "ReadSchema: struct<active:boolean,title:string,year:bigint,owner:string>" in plan
    stack.write("Note", frame(spark, [("Note-50", "changed")], "_id string, title string"))
    plan = plan_of(read())
    assert "GreaterThan(year,45)" in plan and "LeftAnti" in plan and "BroadcastExchange" in plan
    assert sorted(r.title for r in read().collect()) == ["changed", "t46", "t47", "t48"]
    stack.compact("Note")
    assert "Exchange" not in plan_of(read()) and sorted(r.title for r in read().collect()) == ["changed", "t46", "t47", "t48"]
    assert stack.write("Note", frame(spark, [("Note-1", 99)], "_id string, year long")) == 3 and read().count() == 5


def test_keys_are_in_no_plan(spark, tmp_path):
    key = bytes(range(65, 97))
    stack = Stack(spark, str(tmp_path / "s"), key=key, encrypts=True)
    stack.create_class(ClassModel("Item", (Attribute("secret", encrypted=True),)))
    stack.write("Item", frame(spark, [("x",)], "secret string"))
    plan = plan_of(stack.scan("Item")) + stack.scan("Item")._jdf.queryExecution().toString()
    assert key.hex().upper() not in plan.upper() and key.decode() not in plan and stack.scan("Item").first().secret == "x"


def test_encryption(spark, tmp_path):
    key = derived_key("secret", b"salt", 1000)
    stack = Stack(spark, str(tmp_path / "s"), key=key, encrypts=True)
    stack.create_class(ClassModel("Item", (Attribute("title", primary_key=True), Attribute("secret", encrypted=True), Attribute("n", "integer", encrypted=True))))
    stack.create_class(ClassModel("Locked", (Attribute("secret", encrypted=True),)))
    stack.write("Item", frame(spark, [("a", "s1", 7), ("b", None, None)], "title string, secret string, n long"))
    stack.write("Locked", frame(spark, [("x",)], "secret string"))
    assert sorted((r.title, r.secret, r.n) for r in stack.scan("Item").collect()) == [("a", "s1", 7), ("b", None, None)]
    assert stack.find("Item", {"secret": "s1"}).count() == 1
    raw = "".join(str(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/s/Item").collect())
    assert "s1" not in raw and "AES-GCM" in raw
    for wrong, rows, locked in ((None, 2, 0), (bytes(32), 2, 1)):
        stack.key = wrong
        assert [r.secret for r in stack.scan("Item").collect()] == [None] * rows
        assert stack.scan("Locked").count() == locked


def test_triggers_and_jobs(spark, stack):
    stack.create_class(ClassModel("Doc", (Attribute("v", "integer"), Attribute("flag", "boolean"), Attribute("audit", "integer"))))
    seen = []
    stack.jobs.register(Job("note", lambda params, metadata: seen.append(params["event"]["document"].count())))
    stack.triggers += [Trigger("flag", "Doc", sets={"flag": "true"}), Trigger("audit", "Doc", "after", sets={"audit": "coalesce(audit, 0) + 1"}), Trigger("job", "Doc", job="note"), Trigger("none", "Doc", run=lambda df: None)]
    stack.write("Doc", frame(spark, [(5,)], "v long"))
    assert [(r.v, r.flag, r.audit) for r in stack.scan("Doc").collect()] == [(5, True, 1)] and seen == [1]

    jobs = Jobs()

    def count(params, metadata):
        metadata["counter"] = params["value"] + params["step"]

    job = jobs.register(Job("counter", count, {"value": 1, "step": 1}))
    assert jobs.run("counter", value=5).state == "SUCCESS" and job.metadata == {"counter": 6}
    jobs.register(Job("broken", lambda params, metadata: 1 / 0))
    assert jobs.run("broken").state == "FAILURE" and "ZeroDivision" in jobs.runs[-1].error
    job.enabled = False
    with pytest.raises(JobSkipped, match="disabled"):
        jobs.run("counter")
    job.enabled, job.hash = True, "other"
    with pytest.raises(JobSkipped, match="changed"):
        jobs.run("counter")
    assert [r.state for r in jobs.runs] == ["SUCCESS", "FAILURE", "SKIPPED", "SKIPPED"]


def test_runs_and_metadata_outlive_the_process(spark, tmp_path):
    def count(params, metadata):
        metadata["n"] = metadata.get("n", 0) + 1

    for n in (1, 2):
        stack = Stack(spark, str(tmp_path / "s"))  # as another process would
        job = stack.jobs.register(Job("count", count, singleton=True))
        stack.jobs.run("count")
        assert job.metadata == {"n": n}
    assert [r.state for r in stack.jobs.stored().collect()] == ["SUCCESS"] * 2
    other = Stack(spark, str(tmp_path / "s"))
    other.jobs.register(Job("count", count, singleton=True))
    run = JobRun("r", "count", "PENDING", 0.0)
    stack.jobs._note(run, "RUNNING")
    with pytest.raises(JobSkipped, match="running"):
        other.jobs.run("count")


def test_saved_models_are_fed(spark, tmp_path):
    stack, seen = Stack(spark, str(tmp_path / "s")), []
    stack.create_class(ClassModel("One", (Attribute("a"),)))
    stack.save()
    watch = lambda: live_models(spark, stack.path, str(tmp_path / "c"), lambda models, changes: seen.append((sorted(r.name for r in models.collect()), sorted((r.name, r.change) for r in changes.collect())))).awaitTermination()
    watch()
    stack.create_class(ClassModel("Two"))
    stack.create_domain(Domain("to", "N:N", "One", "Two"))
    stack.save()
    watch()
    assert seen[0] == (["One"], [("One", "added")]) and seen[1][0] == ["One", "Two", "to"]
    before = frame(spark, [("class", "A", "1"), ("class", "B", "1")], MODELS)
    changes = model_changes(before, frame(spark, [("class", "B", "2"), ("class", "C", "1")], MODELS))
    assert sorted((r.name, r.change) for r in changes.collect()) == [("A", "removed"), ("B", "changed"), ("C", "added")]


def test_patches_and_schema_change(spark, stack):
    one = ClassModel("Todo", (Attribute("title"),))
    two = one.with_attribute(Attribute("done", "boolean", default=False)).with_attribute(Attribute("rank", "integer"))
    patches = [Patch("1.10.0", "app", (two,)), Patch("1.2.0", "app", (one,), {"Todo": [{"_id": "Todo-1", "title": "x"}]}), Patch("1.2.0", "app")]
    assert [p.version for p in pending(patches, None)] == ["1.2.0", "1.10.0"] and [p.version for p in pending(patches, "1.9.9")] == ["1.10.0"]
    assert stack.apply(patches) == ["1.2.0", "1.10.0"] and stack.apply(patches) == []
    assert [(r.title, r.done, r.rank) for r in stack.scan("Todo").collect()] == [("x", False, None)]
    again = Stack.open(spark, stack.path)
    assert again.version == "1.10.0" and again.apply(patches) == [] and [r.version for r in again.patches().orderBy("applied").collect()] == ["1.2.0", "1.10.0"]
    stack.change_class(two.without_attribute("title"))
    assert "title" not in stack.scan("Todo").columns
    assert [m.name for m in stack.models(search="tod")] == ["Todo"]


def test_feed_and_live_view(spark, stack, tmp_path):
    stack.create_class(ClassModel("Doc", (Attribute("v", "integer"),)))
    stack.write("Doc", frame(spark, [(1,), (2,)], "v long"))
    feed = lambda: change_feed(spark, f"{stack.path}/Doc", stack.model("Doc").struct(), "Doc")
    view = lambda: live_view(feed(), str(tmp_path / "view"), str(tmp_path / "checkpoint"), F.col("v") > 1)
    first = view()
    first.awaitTermination()
    shown = lambda q: sorted((r._id, r.v) for r in current(spark, str(tmp_path / "view"), last_batch(q)).collect())
    assert shown(first) == [("Doc-2", 2)]
    stack.write("Doc", frame(spark, [("Doc-1", 10)], "_id string, v long"))
    stack.delete("Doc", frame(spark, [("Doc-2",)], "_id string"))
    second = view()
    second.awaitTermination()
    assert shown(second) == [("Doc-1", 10)]


def test_selector_of_nested_and_null_values(spark):
    df = frame(spark, [(1, ([1, 5],)), (2, ([],)), (3, None)], "i int, s struct<xs:array<int>>")
    ids = lambda c: [r.i for r in find(df, c, sort=["i"]).collect()]
    assert ids({"s.xs": {"$elemMatch": {"$gt": 4}}}) == [1]
    assert ids({"s.xs": {"$allMatch": {"$gte": 1}}}) == [1]
    assert ids({"s": {"$exists": False}}) == [3] and ids({"s": None}) == [3]
    assert ids({"s.xs": {"$not": {"$size": 2}}}) == [2, 3]
    assert ids({"i": {"$type": "number"}, "$nor": [{"i": 1}]}) == [2, 3]
    assert ids({"s": {"xs": {"$size": 2}}}) == [1]
    with pytest.raises(ValueError, match="unknown operator"):
        find(df, {"i": {"$near": 1}})


def test_catalog_is_kept_and_reset(spark, tmp_path):
    path = str(tmp_path / "s")
    stack = Stack(spark, path)
    stack.create_class(ClassModel("Doc", (Attribute("v", "enum", values=("a", "b")),), "about"), default_policy=True)
    stack.create_class(ClassModel("Other", (Attribute("w"),)))
    stack.create_domain(Domain("to", "N:N", "Doc", "Other"))
    stack.session = Session("ann")
    stack.write("Doc", frame(spark, [("a",)], "v string"))
    stack.change_class(stack.model("Doc").with_attribute(Attribute("n", "integer", default=3)))
    stack.save()
    again = Stack.open(spark, path, session=Session("bob"))
    assert again.classes == stack.classes and again.domains == stack.domains and again.policies == stack.policies
    assert [(r.v, r.n) for r in again.scan("Doc").collect()] == [("a", 3)]
    with pytest.raises(ValueError, match="encrypts=False"):
        Stack.open(spark, path, encrypts=True)
    again.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "Doc")).count() == 1
    again.drop_class("Doc")
    assert "Doc" not in again.classes
    again.reset()
    assert Stack.open(spark, path).classes == {}


def test_users(spark, tmp_path):
    stack = Stack(spark, str(tmp_path / "s"), key=bytes(32), encrypts=True)
    stack.create_class(ClassModel("Doc", (Attribute("t"), Attribute("v", encrypted=True))))
    stack.write("Doc", frame(spark, [("t", "x")], "t string, v string"))
    stack.create_user("ann", "pw", ("g",))
    other = Stack(spark, str(tmp_path / "s"), encrypts=True, classes=dict(stack.classes))
    assert [r.v for r in other.scan("Doc").collect()] == [None]
    for name, password in (("ann", "no"), ("eve", "pw")):
        with pytest.raises(NotAuthenticated):
            other.authenticate(name, password)
    assert other.authenticate("ann", "pw").groups == ("g",) and [r.v for r in other.scan("Doc").collect()] == ["x"]


def test_replication_into_another_log(spark, stack, tmp_path):
    model = stack.create_class(ClassModel("Doc", (Attribute("v", "integer"),)))
    stack.write("Doc", frame(spark, [(1,), (2,)], "v long"))
    stack.write("Doc", frame(spark, [("Doc-1", 5)], "_id string, v long"))
    stack.delete("Doc", frame(spark, [("Doc-2",)], "_id string"))
    remote = DocumentLog(spark, str(tmp_path / "remote"), model)
    feed = change_feed(spark, f"{stack.path}/Doc", model.struct())
    replicate(feed, into_log(remote), str(tmp_path / "c"), seconds=None).awaitTermination()
    assert [(r._id, r.v) for r in remote.documents().collect()] == [("Doc-1", 5)] and remote.documents(inactive=True).count() == 2
