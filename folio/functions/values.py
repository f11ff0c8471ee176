"""Scalar helpers: content hashes, version order, field-by-field differences."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def version_key(c: Column) -> Column:
    """A sortable form of a version like 1.10.2: its numbers as an array; what follows a - or + doesn't count."""
    return F.transform(F.split(F.regexp_replace(c, r"[-+].*$", ""), r"\."), lambda x: x.cast("long"))


def parse_version(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split("-")[0].split("+")[0].split("."))


def changed_fields(old: Column, new: Column, names: list[str]) -> Column:
    """The names of the fields in which two structs differ; null equals null."""
    return F.filter(F.array(*(F.when(~old[n].eqNullSafe(new[n]), F.lit(n)) for n in names)), lambda x: x.isNotNull())


def derived_key(password: str, salt: bytes, iterations: int = 120_000) -> bytes:
    """A 256-bit key by PBKDF2 with SHA-256."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)
