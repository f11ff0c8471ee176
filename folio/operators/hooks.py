"""Triggers around writes, and jobs: registered callables and SQL expressions; stored text is never executed as Python."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.documents import latest


@dataclass(frozen=True)
class Trigger:
    """sets: column -> SQL expression; or run: DataFrame -> DataFrame, whose None leaves the documents as they are; or job."""

    name: str
    target: str
    order: str = "before"
    sets: dict[str, str] = field(default_factory=dict)
    run: Callable[[DataFrame], DataFrame | None] | None = None
    job: str | None = None


def apply_triggers(df: DataFrame, triggers: list[Trigger], cls: str, order: str, jobs: Jobs | None = None) -> DataFrame:
    for t in triggers:
        if t.target != cls or t.order != order:
            continue
        if t.job is not None:
            jobs.run(t.job, event={"document": df})
        if t.sets:
            df = df.withColumns({c: F.expr(e) for c, e in t.sets.items()})
        if t.run is not None:
            df = t.run(df) or df
    return df


@dataclass
class Job:
    name: str
    run: Callable
    defaults: dict = field(default_factory=dict)
    enabled: bool = True
    singleton: bool = False
    metadata: dict = field(default_factory=dict)
    hash: str = ""

    def source_hash(self) -> str:
        return hashlib.sha256(inspect.getsource(self.run).encode()).hexdigest()


@dataclass
class JobRun:
    id: str
    job: str
    state: str
    started: float
    ended: float | None = None
    result: object = None
    error: str | None = None


class JobSkipped(RuntimeError):
    pass


RUNS = "id string, job string, state string, started double, ended double, error string, metadata string, number long"


class Jobs:
    """Registered jobs and the log of their runs: PENDING, RUNNING, then SUCCESS, FAILURE or SKIPPED.

    With keep(), every state of a run and the job's metadata after it are rows of a table: another process sees which runs are
    RUNNING, and register() takes up the metadata where the last run left it."""

    def __init__(self) -> None:
        self.jobs: dict[str, Job] = {}
        self.runs: list[JobRun] = []
        self.spark: SparkSession | None = None
        self.path = ""

    def keep(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def stored(self) -> DataFrame | None:
        """The newest state of every run; None if nothing is kept."""
        try:
            rows = self.spark.read.schema(RUNS).parquet(self.path) if self.spark else None
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return latest(rows, "id", "number") if rows is not None else None

    def _note(self, run: JobRun, state: str) -> None:
        run.state = state
        if self.spark:
            metadata = json.dumps(self.jobs[run.job].metadata, default=str)
            row = (run.id, run.job, state, run.started, run.ended, run.error, metadata, time.time_ns())
            self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(self.path)

    def register(self, job: Job) -> Job:
        job.hash = job.source_hash()
        kept = self.stored()
        if kept is not None:
            last = kept.where(F.col("job") == job.name).agg(F.max_by("metadata", "number")).first()[0]
            job.metadata.update(json.loads(last) if last else {})
        self.jobs[job.name] = job
        return job

    def _busy(self, job: Job) -> bool:
        if any(r.job == job.name and r.state == "RUNNING" for r in self.runs):
            return True
        kept = self.stored()
        return kept is not None and kept.where((F.col("job") == job.name) & (F.col("state") == "RUNNING")).limit(1).count() > 0

    def run(self, name: str, **args) -> JobRun:
        job = self.jobs[name]
        run = JobRun(uuid.uuid4().hex, name, "PENDING", time.time())
        self.runs.append(run)
        busy = job.singleton and self._busy(job)
        if not job.enabled or busy or job.source_hash() != job.hash:
            run.ended = time.time()
            self._note(run, "SKIPPED")
            raise JobSkipped(f"{name} is {'disabled' if not job.enabled else 'running' if busy else 'changed since it was registered'}")
        self._note(run, "RUNNING")
        state = "SUCCESS"
        try:
            run.result = job.run(job.defaults | args, job.metadata)
        except Exception as e:  # the run records it
            state, run.error = "FAILURE", f"{type(e).__name__}: {e}"
        run.ended = time.time()
        self._note(run, state)
        return run
