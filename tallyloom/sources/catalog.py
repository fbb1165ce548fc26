"""Definitions of tables and fields: what catalogs say, in one form, and what is persisted."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from typing import Iterable

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, StructField, StructType, TimestampNTZType

from .names import canonical_type

#: How far a declared type is trusted before values were looked at.
DECLARED = 0.98


@dataclass(frozen=True)
class SourceField:
    """One column as its store's catalog describes it."""

    silo_id: str
    table_schema: str
    table_name: str
    column_name: str
    data_type: str
    udt_name: str
    is_nullable: bool = True
    column_default: str | None = None
    numeric_precision: int | None = None
    numeric_scale: int | None = None
    datetime_precision: int | None = None
    char_max_length: int | None = None


def _text(x: object) -> str | None:
    return None if x is None else bytes(x).decode("utf-8") if isinstance(x, (bytes, bytearray)) else str(x)


def _number(x: object) -> int | None:
    return None if x is None else max(-(2**31), min(2**31 - 1, int(x)))


def from_information_schema(silo_id: str, row: dict, udt: str = "udt_name") -> SourceField:
    """A row of information_schema.columns, of PostgreSQL as it is, of MySQL with bytes for texts and udt='column_type'."""
    r = {k.lower(): v for k, v in row.items()}
    return SourceField(
        silo_id, _text(r["table_schema"]), _text(r["table_name"]), _text(r["column_name"]), _text(r["data_type"]), _text(r.get(udt) or r["data_type"]), _text(r["is_nullable"]).strip().lower() in ("yes", "true"), _text(r.get("column_default")),
        _number(r.get("numeric_precision")), _number(r.get("numeric_scale")), _number(r.get("datetime_precision")), _number(r.get("character_maximum_length")),
    )


def from_pragma(silo_id: str, table: str, name: str, declared: str, notnull: int, default: object) -> SourceField:
    """A row of SQLite's table_info."""
    kind = (declared or "").lower()
    return SourceField(silo_id, "default", table, name, kind, kind, not notnull, _text(default))


def stable_id(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]


@dataclass
class FieldDef:
    id: str
    table_id: str
    name: str
    canonical_type: str
    type_confidence: float | None = None
    column_default: str | None = None
    is_nullable: bool = True
    char_max_length: int | None = None
    numeric_precision: int | None = None
    numeric_scale: int | None = None
    datetime_precision: int | None = None

    def __str__(self) -> str:
        lines = [f"field {self.name} ({self.id}) of table {self.table_id}", f"type: {self.canonical_type}", f"nullable: {str(self.is_nullable).lower()}"]
        more = {"confidence": self.type_confidence, "default": self.column_default, "longest text": self.char_max_length, "precision": self.numeric_precision, "scale": self.numeric_scale, "digits of seconds": self.datetime_precision}
        return "\n  ".join(lines + [f"{k}: {v}" for k, v in more.items() if v is not None])


@dataclass
class TableDef:
    id: str
    silo_id: str
    table_schema: str
    name: str
    fields: list[FieldDef] = field(default_factory=list)

    def rep(self) -> "TableRep":
        return TableRep(self.id, self.silo_id, self.table_schema, self.name, [f.id for f in self.fields], len(self.fields))


@dataclass
class TableRep:
    """A table with its fields' ids only: what is persisted and searched."""

    id: str
    silo_id: str
    table_schema: str
    name: str
    fields: list[str]
    num_fields: int


def table_defs(columns: Iterable[SourceField]) -> list[TableDef]:
    """Tables in order of their names; fields in the order they came. Tables of one name in two schemas are two."""
    out: dict[tuple[str, str, str], TableDef] = {}
    for c in columns:
        key = (c.silo_id, c.table_schema, c.table_name)
        table = out.setdefault(key, TableDef(stable_id(*key), *key))
        kind = canonical_type(c.udt_name, c.numeric_precision if c.datetime_precision is None else c.datetime_precision, c.numeric_scale)
        table.fields.append(FieldDef(stable_id(*key, c.column_name), table.id, c.column_name, kind, DECLARED, c.column_default, c.is_nullable, c.char_max_length, c.numeric_precision, c.numeric_scale, c.datetime_precision))
    return [out[k] for k in sorted(out)]


_SPARK = {
    "Int8": ByteType(), "Int16": ShortType(), "Int32": IntegerType(), "Int64": LongType(), "UInt8": ShortType(), "UInt16": IntegerType(), "UInt32": LongType(), "UInt64": DecimalType(20, 0), "Float16": FloatType(), "Float32": FloatType(), "Float64": DoubleType(),
    "Boolean": BooleanType(), "Date32": DateType(), "Binary": BinaryType(), "LargeBinary": BinaryType(), "FixedSizeBinary": BinaryType(), "Null": NullType(), "Timestamp": TimestampNTZType(), "Time32": LongType(), "Time64": LongType(),
}


def spark_type(kind: str) -> DataType:
    """The physical type of a logical one; times of day are numbers, what Spark can't tell apart is text."""
    family, _, inside = kind.partition("(")
    if family.startswith("Decimal"):
        p, s = (int(x) for x in inside[:-1].split(","))
        return DecimalType(min(p, 38), min(s, 38))
    if family in ("List", "LargeList", "ListView", "LargeListView"):
        return ArrayType(spark_type(inside[:-1]))
    return _SPARK.get(family, StringType())


def physical_schema(table: TableDef) -> StructType:
    return StructType([StructField(f.name, spark_type(f.canonical_type), f.is_nullable) for f in table.fields])


def promoted(f: FieldDef, target: str, confidence: float, nullable: bool, meta: dict[str, int | None]) -> FieldDef:
    """The field after its values were looked at."""
    return replace(f, canonical_type=target, type_confidence=confidence, is_nullable=nullable, **(meta if target != f.canonical_type else {}))


#: Kinds of character signatures; only that of texts and bytes has shares.
SIGNATURES = ("bool", "charclass", "nested", "numeric", "opaque", "temporal")


def signature(kind: str, shares: list[float] | None = None) -> tuple[str, list[float] | None]:
    """A checked signature, as it is stored."""
    if kind not in SIGNATURES:
        raise ValueError(f"no such kind of signature: {kind}")
    if (kind == "charclass") != (shares is not None) or (shares is not None and len(shares) != 5):
        raise ValueError("character classes have five shares, other kinds none")
    return kind, shares
