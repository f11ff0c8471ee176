"""Classes of documents: attributes with constraints, their Spark types, and the rules that values must keep."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that every document has, beside its class's attributes.
SYSTEM = T.StructType(
    [
        T.StructField("_id", T.StringType(), False), T.StructField("_rev", T.LongType(), False), T.StructField("~class", T.StringType(), False),
        T.StructField("active", T.BooleanType(), False), T.StructField("~createTimestamp", T.LongType()), T.StructField("~updateTimestamp", T.LongType()),
    ]
)

TYPES = {
    "string": T.StringType(), "integer": T.LongType(), "decimal": T.DoubleType(), "boolean": T.BooleanType(), "object": T.MapType(T.StringType(), T.StringType()),
    "enum": T.StringType(), "foreign_key": T.StringType(), "reference": T.StringType(), "date": T.TimestampNTZType(),
}


def col(name: str) -> Column:
    """A column by its whole name, dots and ~ included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Attribute:
    """One attribute of a class. values: of an enum; target: the class of a foreign key; domain: the relation of a reference."""

    name: str
    type: str = "string"
    mandatory: bool = False
    is_array: bool = False
    primary_key: bool = False
    encrypted: bool = False
    default: object = None
    min: float | None = None
    max: float | None = None
    max_length: int | None = None
    precision: int | None = None
    values: tuple[str, ...] = ()
    target: str | None = None
    domain: str | None = None
    whole: bool = False

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unsupported attribute type {self.type}")
        if self.type == "enum" and not self.values:
            raise ValueError(f"enum {self.name} has no values")
        if self.type == "foreign_key" and not self.target:
            raise ValueError(f"foreign key {self.name} has no target class")
        if self.type == "reference" and (not self.domain or self.is_array):
            raise ValueError(f"reference {self.name} needs a domain and can't be an array")

    def spark_type(self) -> T.DataType:
        return T.ArrayType(TYPES[self.type]) if self.is_array else TYPES[self.type]

    def field(self) -> T.StructField:
        config = {k: v for k, v in self.__dict__.items() if v is not None and k not in ("name", "values", "default")} | {"values": list(self.values)}
        return T.StructField(self.name, self.spark_type(), True, config)

    def _value_rules(self, v: Column) -> dict[str, Column]:
        rules = {}
        if self.type == "string" and self.max_length is not None:
            rules["max_length"] = F.length(v) > self.max_length
        if self.type in ("integer", "decimal"):
            if self.min is not None:
                rules["min"] = v < self.min
            if self.max is not None:
                rules["max"] = v > self.max
            if self.type == "integer" and self.whole:
                rules["whole"] = v != F.floor(v)
            if self.type == "decimal" and self.precision is not None:
                rules["precision"] = v != F.round(v, self.precision)
        if self.type == "enum":
            rules["enum"] = ~v.isin(list(self.values))
        if self.type in ("reference", "foreign_key"):
            rules["empty"] = v == ""
        return rules

    def violations(self) -> dict[str, Column]:
        """rule -> Column that is true where a document breaks it; null values break only `mandatory`."""
        c = col(self.name)
        broken = {"mandatory": c.isNull()} if self.mandatory else {}
        for rule in self._value_rules(F.lit(None)):
            if self.is_array:
                test = F.exists(c, lambda v, r=rule: F.coalesce(self._value_rules(v)[r], F.lit(False)))
            else:
                test = self._value_rules(c)[rule]
            broken[rule] = F.coalesce(test, F.lit(False))
        return {f"{self.name}.{k}": v for k, v in broken.items()}


@dataclass(frozen=True)
class ClassModel:
    """A named set of documents of one schema."""

    name: str
    attributes: tuple[Attribute, ...] = ()
    description: str = ""
    id: str = field(default="")

    def struct(self, system: bool = True) -> T.StructType:
        return T.StructType([*(SYSTEM.fields if system else []), *(a.field() for a in self.attributes)])

    def attribute(self, name: str) -> Attribute:
        found = [a for a in self.attributes if a.name == name]
        if not found:
            raise KeyError(f"{self.name} has no attribute {name}")
        return found[0]

    @property
    def primary_key(self) -> list[str]:
        return [a.name for a in self.attributes if a.primary_key]

    @property
    def encrypted(self) -> list[Attribute]:
        """Attributes stored encrypted; a primary key never is."""
        return [a for a in self.attributes if a.encrypted and not a.primary_key]

    def with_attribute(self, attribute: Attribute) -> ClassModel:
        """Adds an attribute, or replaces the one of its name."""
        kept = tuple(attribute if a.name == attribute.name else a for a in self.attributes)
        return replace(self, attributes=kept if any(a.name == attribute.name for a in self.attributes) else (*kept, attribute))

    def without_attribute(self, name: str) -> ClassModel:
        self.attribute(name)
        return replace(self, attributes=tuple(a for a in self.attributes if a.name != name))


def entity_diagram(classes: list[ClassModel], domains: list) -> str:
    """Mermaid text of classes and their relations."""
    ends = {"1:1": "||--||", "1:N": "||--o{", "N:1": "}o--||", "N:N": "}o--o{"}
    lines = ["erDiagram"]
    for c in classes:
        lines.append(f"  {c.name} {{")
        lines += [f"    {a.type}{'[]' if a.is_array else ''} {a.name}{' PK' if a.primary_key else ''}" for a in c.attributes]
        lines.append("  }")
    lines += [f"  {d.source} {ends[d.cardinality]} {d.target} : {d.name}" for d in domains]
    return "\n".join(lines)
