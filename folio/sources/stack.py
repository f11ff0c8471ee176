"""A stack: classes, relations, policies, triggers and their documents, queried with SQL or selectors.

Every read goes through scan(), where policies and decryption are part of the plan, so that subqueries and joins can't pass
them by. SQL is Spark's, over views named as the classes; "double quotes" make identifiers. A text that is no query, or that
names anything but classes and its own common table expressions (files, other tables and views), is refused.
"""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import crypto
from folio.functions.selectors import find
from folio.functions.values import derived_key
from folio.operators import relations
from folio.operators.hooks import Jobs, Trigger, apply_triggers
from folio.operators.patches import Patch, pending
from folio.operators.policies import NotAuthenticated, Policy, Session, allowed, ensure_writable
from folio.operators.relations import Domain
from folio.operators.rows import numbered, sequential_ids
from folio.operators.validation import ensure_valid, missing_targets, propagate
from folio.sources import files
from folio.sources.documents import DocumentLog, merge
from folio.sources.schema import Attribute, ClassModel, col
from folio.sources.store import settled

EDGE_MODEL = ClassModel("~edges")
#: Columns that the log sets itself.
STAMPS = ("_rev", "~class", "active", "~createTimestamp", "~updateTimestamp")
#: Functions that run code outside of SQL.
FOREIGN = re.compile(r"(?i)\b(?:try_)?(?:reflect|java_method)\(")
USER = ClassModel("User", (Attribute("username", mandatory=True, primary_key=True), Attribute("salt"), Attribute("sealed"), Attribute("groups", is_array=True)))
PATCHES = "version string, target string, changelog string, applied long"
EDGE_STRUCT = T.StructType([T.StructField(c.strip("`"), T.StringType()) for c in relations.EDGE])


@dataclass
class Stack:
    spark: SparkSession
    path: str
    session: Session | None = None
    key: bytes | None = None
    encrypts: bool = False
    classes: dict[str, ClassModel] = field(default_factory=dict)
    domains: dict[str, Domain] = field(default_factory=dict)
    policies: list[Policy] = field(default_factory=list)
    triggers: list[Trigger] = field(default_factory=list)
    jobs: Jobs = field(default_factory=Jobs)
    version: str | None = None
    generation: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.jobs.keep(self.spark, f"{self.path}/~jobs")

    # the catalog: classes, relations, policies and version; triggers and jobs are code and registered anew
    def save(self) -> None:
        """Appends the catalog to the stack's folder; open() reads the last."""
        text = json.dumps(
            {
                "classes": [asdict(c) for c in self.classes.values()],
                "domains": [asdict(d) for d in self.domains.values()],
                "policies": [asdict(p) for p in self.policies],
                "version": self.version,
                "encrypts": self.encrypts,
                "generation": self.generation,
            }
        )
        number = (self._catalogs().agg(F.max("number")).first()[0] or 0) + 1
        self.spark.createDataFrame([(number, text)], "number long, text string").write.mode("append").parquet(f"{self.path}/~catalog")

    def _catalogs(self) -> DataFrame:
        try:
            return self.spark.read.schema("number long, text string").parquet(f"{self.path}/~catalog")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "number long, text string")

    @classmethod
    def open(cls, spark: SparkSession, path: str, encrypts: bool = False, **how) -> Stack:
        """A stack with the catalog that was saved last; whether it encrypts can't change."""
        stack = cls(spark, path, encrypts=encrypts, **how)
        last = stack._catalogs().agg(F.max_by("text", "number")).first()[0]
        if last is None:
            return stack
        kept = json.loads(last)
        if kept["encrypts"] != encrypts:
            raise ValueError(f"the stack was made with encrypts={kept['encrypts']}")
        for c in kept["classes"]:
            attributes = tuple(Attribute(**a | {"values": tuple(a["values"])}) for a in c.pop("attributes"))
            stack.classes[c["name"]] = ClassModel(attributes=attributes, **c)
        stack.domains = {d["name"]: Domain(**d) for d in kept["domains"]}
        stack.policies = [Policy(**p | {"operations": tuple(p["operations"])}) for p in kept["policies"]]
        stack.version, stack.generation = kept["version"], kept["generation"]
        return stack

    def drop_class(self, name: str) -> None:
        """Forgets a class and deletes its documents."""
        model = self.classes.pop(self.model(name).name)
        files.remove(self.spark, self._log(model).path)
        self.generation.pop(model.name, None)

    def reset(self) -> None:
        """Deletes everything below the stack's folder, and forgets it."""
        files.remove(self.spark, self.path)
        for kept in (self.classes, self.domains, self.policies, self.triggers, self.generation):
            kept.clear()
        self.version = None

    def export(self, path: str, kind: str = "json") -> None:
        """Writes what the session may read of every class, a folder each."""
        for name in self.classes:
            files.export(self.scan(name), f"{path}/{name}", kind)

    # users
    def create_user(self, username: str, password: str, groups: tuple[str, ...] = ()) -> None:
        """A user whose password seals the stack's key."""
        self.classes.setdefault("User", USER)
        salt = os.urandom(16)
        sealed = crypto.wrap_key(self.spark, self.key or b"", derived_key(password, salt))
        row = (f"User-{username}", username, salt.hex(), sealed, list(groups))
        self.write("User", self.spark.createDataFrame([row], "_id string, username string, salt string, sealed string, groups array<string>"))

    def authenticate(self, username: str, password: str) -> Session:
        """Opens the user's session; a wrong name or password is an error."""
        user = self._log(USER).documents().where(F.col("username") == username).first()
        key = crypto.unwrap_key(self.spark, user["sealed"], derived_key(password, bytes.fromhex(user["salt"]))) if user else None
        if key is None:
            raise NotAuthenticated("wrong name or password")
        self.key = key or None
        self.session = Session(username, user["_id"], tuple(user["groups"] or ()))
        return self.session

    # classes and relations
    def create_class(self, model: ClassModel, default_policy: bool = False) -> ClassModel:
        if any(a.name == "session" for a in model.attributes):
            raise ValueError(f"{model.name}: policies need the name session for themselves")
        self.classes[model.name] = model
        if default_policy:
            self.policies.append(Policy(model.name, "session.username IS NOT NULL"))
        return model

    def model(self, name: str) -> ClassModel:
        """By name or id."""
        for m in self.classes.values():
            if name in (m.name, m.id):
                return m
        raise KeyError(f"Table not found: {name}")

    def models(self, ids: list[str] | None = None, search: str | None = None) -> list[ClassModel]:
        """By ids, or by text found, whatever its case, in id, name or description."""
        found = [m for m in self.classes.values() if ids is None or m.id in ids or m.name in ids]
        return [m for m in found if search is None or any(search.lower() in x.lower() for x in (m.id, m.name, m.description))]

    def create_domain(self, domain: Domain) -> Domain:
        self.model(domain.source), self.model(domain.target)
        self.domains[domain.name] = domain
        return domain

    def change_class(self, new: ClassModel) -> None:
        """Replaces a model and rewrites its documents to it, as one more revision."""
        old = self.model(new.name)
        docs = self._log(old).documents()
        clear = crypto.decrypt(docs, old, self.key)
        self.classes[new.name] = new
        moved = propagate(clear, old, new)
        self._store(new, moved.drop(*STAMPS), fresh_folder=True)

    def compact(self, name: str) -> None:
        """Writes the newest revisions of a class's documents to a fresh folder, where reading needs no look at older ones; their
        history stays in the old folder. The catalog is saved."""
        model = self.model(name)
        old = self._log(model)
        self.generation[model.name] = self.generation.get(model.name, 0) + 1
        old.write_compact(self._log(model))
        self.save()

    # storage
    def _struct(self, model: ClassModel) -> T.StructType:
        sealed = {a.name for a in model.encrypted} if self.encrypts else set()
        return T.StructType(
            [T.StructField(f.name, crypto.STORED, True) if f.name in sealed else T.StructField(f.name, f.dataType, True) for f in model.struct()]
        )

    def _log(self, model: ClassModel) -> DocumentLog:
        generation = self.generation.get(model.name, 0)
        return DocumentLog(self.spark, f"{self.path}/{generation}" if generation else self.path, model, self._struct(model))

    def _store(self, model: ClassModel, docs: DataFrame, fresh_folder: bool = False) -> int:
        sealed = crypto.encrypt(docs, model, self.key) if self.encrypts else docs
        if fresh_folder:  # another schema: the old files stay in the old folder
            self.generation[model.name] = self.generation.get(model.name, 0) + 1
        return self._log(model).append(sealed)

    # reading
    def scan(self, name: str, inactive: bool = False) -> DataFrame:
        """The documents of a class that the session may read, in clear where there is a key."""
        model = self.model(name)
        docs = self._log(model).documents(inactive)
        return crypto.decrypt(allowed(docs, self.policies, model.name, self.session), model, self.key)

    def find(self, name: str, condition: dict | None = None, **page) -> DataFrame:
        return find(self.scan(name), condition, **page)

    def find_one(self, name: str, condition: dict | None = None, sort: list[str] | None = None) -> DataFrame:
        return self.find(name, condition, sort=sort or ["_id"], limit=1)

    def get(self, name: str, *ids: str) -> DataFrame:
        return self.scan(name).where(F.col("_id").isin(list(ids)))

    def sql(self, text: str, *params, **args) -> DataFrame:
        """A query over views named as the classes; params fill its ? and args its named parameters. An empty text gives an empty
        result."""
        text = text.strip().rstrip(";").strip()
        if not text:
            return self.spark.createDataFrame([], T.StructType([]))
        if params and args:
            raise ValueError("parameters are either ? or named")
        settings = {"spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false"}
        before = {k: self.spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            for name in self._named_classes(text):
                self.scan(name).createOrReplaceTempView(f"`{name}`")
            return self.spark.sql(text, args=list(params) or args or None)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _named_classes(self, text: str) -> list[str]:
        """The classes that a query names; anything else that it reads or does is an error."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        shown = plan.treeString()
        first = re.match(r"[^\w]*(\w+)", shown)[1]
        if self.spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command").isInstance(plan) or "Statement" in first or "InsertInto" in shown:
            raise PermissionError("only queries are allowed")
        if FOREIGN.search(shown):
            raise PermissionError("this function is not allowed")
        own = {n.strip().lower() for names in re.findall(r"CTE \[(.*?)\]", shown) for n in names.split(",")}
        by_name = {m.name.lower(): m.name for m in self.classes.values()}
        found = []
        for relation in re.findall(r"UnresolvedRelation \[(.*?)\]", shown):
            if relation.lower() in own:
                continue
            if relation.lower() not in by_name:
                raise PermissionError(f"Table not found: {relation}")
            found.append(by_name[relation.lower()])
        return sorted(set(found))

    def edges(self, domain: str | None = None) -> DataFrame:
        log = DocumentLog(self.spark, self.path, EDGE_MODEL, T.StructType([*EDGE_MODEL.struct().fields, *EDGE_STRUCT.fields]))
        rows = log.documents()
        return rows if domain is None else rows.where(F.col("`~domain`") == domain)

    def related(self, domain: str) -> DataFrame:
        """(source, target) structs of the documents that a relation links."""
        d = self.domains[domain]
        pack = lambda df, n: df.select(F.col("_id").alias(f"{n}_id"), F.struct(*(col(c) for c in df.columns)).alias(n))
        e = self.edges(domain).select("sourceId", "targetId").distinct()
        return pack(self.scan(d.source), "source").join(e, F.col("source_id") == F.col("sourceId")).join(
            pack(self.scan(d.target), "target"), F.col("target_id") == F.col("targetId"),
        ).select("source", "target")

    # writing
    def write(self, name: str, docs: DataFrame, validate: bool = True) -> int:
        """Adds or changes documents: before-triggers, checks, policies, encryption, append, after-triggers, edges.

        Documents without _id get the next ids. Those of known _id are merged over what is stored."""
        model = self.model(name)
        # what the caller hands over is read once; encrypted attributes are sealed before they are written anywhere
        docs = docs if "_id" in docs.columns else numbered(docs)
        kept, place = settled(crypto.encrypt(docs, model, self.key) if self.encrypts else docs)
        try:
            return self._write(model, crypto.decrypt(kept, model, self.key) if self.encrypts else kept, validate)
        finally:
            files.remove(self.spark, place)

    def _write(self, model: ClassModel, docs: DataFrame, validate: bool) -> int:
        name = model.name
        if "_id" not in docs.columns:
            known = self._log(model).history().select(F.max(F.try_to_number(F.substring_index("_id", "-", -1), F.lit("999999999999999")))).first()[0]
            docs = sequential_ids(docs, model.name, int(known or 0))
        docs = apply_triggers(docs, self.triggers, name, "before", self.jobs)
        if validate:
            stored = self.scan(name)
            whole = [a for a in model.attributes if a.name in docs.columns]
            partial = ClassModel(model.name, tuple(whole)) if docs.join(stored.select("_id"), "_id", "left_anti").limit(1).count() == 0 else model
            ensure_valid(docs, partial, stored.join(docs.select("_id"), "_id", "left_anti") if model.primary_key else None)
            for a in model.attributes:
                if a.type == "foreign_key" and a.name in docs.columns and not a.is_array and missing_targets(docs, a.name, self.scan(a.target)).limit(1).count():
                    raise ValueError(f"{name}.{a.name}: no such {a.target}")
        stored = crypto.decrypt(self._log(model).documents(inactive=True), model, self.key)
        ensure_writable(merge(stored, docs), self.policies, name, self.session)  # rules see whole documents
        rev = self._store(model, docs)
        after = [t for t in self.triggers if t.target == name and t.order == "after"]
        if after:
            written = self._log(model).documents().join(docs.select("_id"), "_id", "left_semi")
            changed = apply_triggers(crypto.decrypt(written, model, self.key), after, name, "after", self.jobs)
            rev = self._store(model, changed.drop(*STAMPS))
        for a in model.attributes:
            if a.type == "reference" and a.name in docs.columns:
                self.relate(a.domain, relations.reference_edges(self.domains[a.domain], docs, name, a.name).select("sourceId", "targetId"))
        return rev

    def push(self, name: str, docs: DataFrame) -> int:
        """Adds or changes documents by primary key: those whose key is stored get its _id."""
        model = self.model(name)
        stored = self.scan(name).select("_id", *(col(k).alias(f"__{k}") for k in model.primary_key))
        same = F.lit(True)
        for k in model.primary_key:
            same = same & (docs[k] == stored[f"__{k}"])
        matched = docs.join(stored, same, "left").drop(*(f"__{k}" for k in model.primary_key))
        old, new = matched.where("_id IS NOT NULL"), matched.where("_id IS NULL").drop("_id")
        if old.limit(1).count():
            self.write(name, old)
        return self.write(name, new) if new.limit(1).count() else self._log(model).revision()

    def delete(self, name: str, ids: DataFrame) -> int:
        """Marks documents inactive; if the policies refuse the write of any of them, none is."""
        model = self.model(name)
        log = self._log(model)
        gone = crypto.decrypt(log.documents(), model, self.key).join(ids.select("_id").distinct(), "_id", "left_semi")
        ensure_writable(gone, self.policies, name, self.session)
        return log.delete(ids)

    def relate(self, domain: str, pairs: DataFrame) -> None:
        """Adds edges (sourceId, targetId) after checking documents and cardinality; known edges are left alone."""
        d = self.domains[domain]
        fresh = relations.edges_of(d, pairs)
        stored = self.edges().select(*relations.EDGE)
        all_ = relations.add_edges(stored, fresh)
        if relations.cardinality_clashes(d, all_).limit(1).count():
            raise ValueError(f"{domain}: cardinality {d.cardinality} is broken")
        if relations.broken_edges(d, fresh, self.scan(d.source), self.scan(d.target)).limit(1).count():
            raise ValueError(f"{domain}: an end of a relation is missing")
        new = fresh.distinct().join(stored.select("`~domain`", "sourceId", "targetId"), ["~domain", "sourceId", "targetId"], "left_anti")
        self._edge_log().append(new.withColumn("_id", F.concat_ws("|", "`~domain`", "sourceId", "targetId")).select("_id", *relations.EDGE))

    def unrelate(self, domain: str, pairs: DataFrame) -> None:
        gone = pairs.select(F.concat_ws("|", F.lit(domain), F.col("sourceId").cast("string"), F.col("targetId").cast("string")).alias("_id"))
        self._edge_log().delete(gone)

    def _edge_log(self) -> DocumentLog:
        return DocumentLog(self.spark, self.path, EDGE_MODEL, T.StructType([*EDGE_MODEL.struct().fields, *EDGE_STRUCT.fields]))

    # patches
    def patches(self) -> DataFrame:
        """The patches that were applied."""
        there = "~patches" in files.folders(self.spark, self.path)
        return self.spark.read.schema(PATCHES).parquet(f"{self.path}/~patches") if there else self.spark.createDataFrame([], PATCHES)

    def apply(self, patches: list[Patch]) -> list[str]:
        """Applies what is above the stack's version, and returns those versions. Patch and version are stored after each."""
        done = []
        for patch in pending(patches, self.version):
            for model in patch.classes:
                if model.name in self.classes:
                    self.change_class(model)
                else:
                    self.create_class(model)
            for name, rows in patch.docs.items():
                model = self.model(name)
                fields = [f for f in model.struct() if any(f.name in r for r in rows)]
                self.write(
                    name,
                    self.spark.createDataFrame(
                        [{f.name: r.get(f.name) for f in fields} for r in rows], T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]),
                    ),
                )
            self.version = patch.version
            row = (patch.version, patch.target, patch.changelog, int(time.time() * 1000))
            self.spark.createDataFrame([row], PATCHES).write.mode("append").parquet(f"{self.path}/~patches")
            self.save()
            done.append(patch.version)
        return done
