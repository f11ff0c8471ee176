"""Versioned patches: ordered by semantic version, applied once each."""

from __future__ import annotations

from dataclasses import dataclass, field

from folio.functions.values import parse_version
from folio.sources.schema import ClassModel


@dataclass(frozen=True)
class Patch:
    """classes: models to add or replace; docs: class -> rows as dicts with _id, merged over what is stored."""

    version: str
    target: str
    classes: tuple[ClassModel, ...] = ()
    docs: dict[str, list[dict]] = field(default_factory=dict)
    changelog: str = ""


def pending(patches: list[Patch], current: str | None) -> list[Patch]:
    """The patches above the current version, lowest first; of equal version and target the first."""
    seen, out = set(), []
    for p in sorted(patches, key=lambda p: parse_version(p.version)):
        if (p.version, p.target) not in seen and (current is None or parse_version(p.version) > parse_version(current)):
            seen.add((p.version, p.target))
            out.append(p)
    return out
