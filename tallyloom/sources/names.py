"""Type names of databases and of documents, as logical types."""

from __future__ import annotations

from functools import reduce

_PLAIN = {
    "Int8": "tinyint int8", "Int16": "smallint int2 serial2 smallserial int16", "Int32": "integer int int4 serial4 serial int32", "Int64": "bigint int64",
    "UInt8": "uint8", "UInt16": "uint16", "UInt32": "uint32", "UInt64": "uint64 uint128", "List(Utf8)": "array vector tsvector", "Boolean": "bool boolean",
    "Float16": "float2 float16", "Float32": "float4 float32", "Float64": "real double float float8 float64", "Date32": "date date32", "Timestamp(ms)": "date64",
    "Binary": "bytea binary blob", "LargeBinary": "jsonb largebinary", "FixedSizeBinary(16)": "uuid", "Utf8View": "utf8view", "Null": "null", "Timestamp(us)": "datetime",
}
TYPE_NAMES = {name: kind for kind, names in _PLAIN.items() for name in names.split()}


#: Names that begin like this already are logical types, written out.
PARSED = ("timestamp(", "decimal32(", "decimal64(", "decimal128(", "decimal256(", "list(", "largelist(", "listview(", "largelistview(", "fixedsizelist(", "time32(", "time64(", "duration(", "interval(", "struct(", "union(", "dictionary(", "map(", "runendencoded(")
_UNITS = {"second": "s", "millisecond": "ms", "microsecond": "us", "nanosecond": "ns", "s": "s", "ms": "ms", "us": "us", "µs": "us", "ns": "ns"}


def parsed_type(text: str) -> str:
    """A written-out logical type in its usual spelling; one that isn't whole is text."""
    family, _, inside = text.partition("(")
    if not inside.endswith(")"):
        return "Utf8"
    inside = inside[:-1].strip()
    proper = {k[:-1]: v for k, v in zip(PARSED, ("Timestamp", "Decimal32", "Decimal64", "Decimal128", "Decimal256", "List", "LargeList", "ListView", "LargeListView", "FixedSizeList", "Time32", "Time64", "Duration", "Interval", "Struct", "Union", "Dictionary", "Map", "RunEndEncoded"))}[family.lower()]
    if proper in ("Timestamp", "Time32", "Time64", "Duration"):
        unit = _UNITS.get(inside.split(",")[0].strip().lower())
        return f"{proper}({unit})" if unit else "Utf8"
    if proper.startswith("Decimal"):
        digits = [x.strip() for x in inside.split(",")]
        return f"{proper}({digits[0]}, {digits[1]})" if len(digits) == 2 and all(x.lstrip("-").isdigit() for x in digits) else "Utf8"
    if proper in ("List", "LargeList", "ListView", "LargeListView"):
        return f"{proper}({canonical_type(inside)})"
    return f"{proper}({inside})"


def canonical_type(name: str, precision: int | None = None, scale: int | None = None) -> str:
    """The logical type that a database's type name stands for; names that aren't known are texts."""
    n = name.strip().lower()
    if n.startswith(PARSED):
        return parsed_type(name.strip())
    if n in ("numeric", "decimal"):
        return f"Decimal128({38 if precision is None else precision}, {10 if scale is None else scale})"
    if n in ("time", "timetz"):
        return "Time32(us)" if precision is None or precision > 6 else "Time32(s)" if precision == 0 else "Time32(ms)" if precision <= 3 else "Time64(us)"
    if n in ("timestamp", "timestamptz"):
        return "Timestamp(us)" if precision is None or precision > 3 else "Timestamp(s)" if precision == 0 else "Timestamp(ms)"
    return TYPE_NAMES.get(n, "Utf8")


def merged_type(a: str, b: str) -> str:
    """The type that holds values of both, as far as document stores need it."""
    if a == b or b == "Null":
        return a
    if a == "Null":
        return b
    pair, number = {a, b}, {"Int32", "Int64", "Float32", "Float64"}
    for x, y in ((a, b), (b, a)):
        if x.startswith("Decimal") and y in number:
            return x
        if x == "Int32" and y in ("Int64", "Float32", "Float64"):
            return y
    if all(x.startswith("List(") for x in pair):
        return f"List({merged_type(a[5:-1], b[5:-1])})"
    return "Utf8"


def document_type(value: object) -> str:
    """The logical type of a value of a document. Lists take the type that holds all of their elements."""
    import datetime
    import decimal

    if value is None:
        return "Null"
    if isinstance(value, bool):
        return "Boolean"
    if isinstance(value, int):
        return "Int32" if -(2**31) <= value < 2**31 else "Int64"
    if isinstance(value, float):
        return "Float64"
    if isinstance(value, decimal.Decimal):
        return "Decimal128(38, 10)"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "Timestamp(ms)"
    if isinstance(value, (bytes, bytearray)):
        return "Binary"
    if isinstance(value, (list, tuple)):
        return f"List({reduce(merged_type, map(document_type, value), 'Null')})"
    return "Struct(item Utf8)" if isinstance(value, dict) else "Utf8"
