"""Row policies compiled into one predicate of the scan.

A rule is a SQL expression over the document's columns and the struct `session` (username, userId, groups). Policies of a
class that name a user or group apply to those only. Where a class has such policies for the operation, its other ones don't
count at all, and a session that none of them names is denied. A document is readable if every applicable rule is true; a null
rule denies. No policy on a class allows all; policies without a session are an error, and so is a column named session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_CLASSES = {"class", "domain", "User", "UserSession", "Policy", "Group", "Job", "JobRun", "AuthModule"}


class NotAuthenticated(PermissionError):
    pass


@dataclass(frozen=True)
class Session:
    username: str
    user_id: str | None = None
    groups: tuple[str, ...] = ()

    def column(self) -> Column:
        return F.struct(
            F.lit(self.username).alias("username"), F.lit(self.user_id).alias("userId"), F.array(*map(F.lit, self.groups)).cast("array<string>").alias("groups"),
        )


@dataclass(frozen=True)
class Policy:
    target: str
    rule: str
    operations: tuple[str, ...] = ("read", "write")
    user: str | None = None
    group: str | None = None

    def targeted(self) -> bool:
        return self.user is not None or self.group is not None

    def matches(self, session: Session) -> bool:
        return (self.user is None or self.user in (session.user_id, session.username)) and (self.group is None or self.group in session.groups)


def plain(name: str) -> str:
    return name.removeprefix("~")


def applicable(policies: list[Policy], cls: str, operation: str, session: Session | None) -> list[Policy] | None:
    """The policies that decide; None if the class is open; an empty list if targeted ones exist but none matches."""
    if plain(cls) in SYSTEM_CLASSES:
        return None
    own = [p for p in policies if plain(p.target) == plain(cls) and operation in p.operations]
    if not own:
        return None
    if session is None:
        raise NotAuthenticated(f"{cls}: a session is needed; not authenticated")
    aimed = [p for p in own if p.targeted()]
    return [p for p in aimed if p.matches(session)] if aimed else own


def _with_session(df: DataFrame, cls: str, session: Session) -> DataFrame:
    if "session" in df.columns:
        raise ValueError(f"{cls}: policies need the name session for themselves; rename the attribute")
    return df.withColumn("session", session.column())


def allowed(df: DataFrame, policies: list[Policy], cls: str, session: Session | None, operation: str = "read") -> DataFrame:
    """The rows of df that the policies allow."""
    rules = applicable(policies, cls, operation, session)
    if rules is None:
        return df
    if not rules:
        return df.where(F.lit(False))
    out = _with_session(df, cls, session)
    for p in rules:  # a filter leaves null out, and a bare rule can be pushed to the files
        out = out.where(F.expr(p.rule))
    return out.drop("session")


def ensure_writable(df: DataFrame, policies: list[Policy], cls: str, session: Session | None) -> None:
    """Raises if the policies refuse a row of df."""
    rules = applicable(policies, cls, "write", session)
    if rules is None:
        return
    checked = _with_session(df, cls, session)
    fine = F.lit(bool(rules))
    for p in rules:
        fine = fine & F.coalesce(F.expr(p.rule), F.lit(False))
    if checked.where(~fine).limit(1).count():
        raise PermissionError(f"{cls}: a policy refuses the write")
