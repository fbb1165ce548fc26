"""Data stores as named DataFrames: Parquet and CSV files, Excel workbooks, SQLite, JDBC databases and MongoDB."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import os
import re
import sqlite3
import zipfile
from dataclasses import dataclass, field
from typing import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import catalog
from .names import canonical_type, document_type, merged_type  # noqa: F401

SAMPLE_ROWS = 10


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """kind, where it is, and options. silo_id names it, and is the same for the same source."""

    kind: str
    location: str
    num_rows: int | None = SAMPLE_ROWS
    has_header: bool = True
    pattern: str | None = None
    options: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.num_rows is not None and self.num_rows < 1:
            raise SourceError("num_rows is 1 or more, or None for all rows")

    @property
    def silo_id(self) -> str:
        """The same for the same kind, place and selection."""
        login = ("user", "password")
        told = [self.kind, self.location, self.pattern or "", str(self.has_header), *(f"{k}={v}" for k, v in sorted(self.options.items()) if k not in login)]
        return f"{self.kind}-{hashlib.sha256(chr(31).join(told).encode()).hexdigest()[:16]}"

    def tables(self, spark: SparkSession, errors: list[str] | None = None) -> dict[str, DataFrame]:
        """Tables by name. A file that can't be read is an error; with a list for them, it is noted there and left out."""
        if self.kind not in READERS:
            raise SourceError(f"no such kind of source: {self.kind}")
        found = {}
        for name, read in READERS[self.kind](spark, self):
            try:
                found |= read()
            except Exception as e:
                if errors is None:
                    raise
                errors.append(f"{self.silo_id}.{name}: {e}")
        return {n: df.limit(self.num_rows) if self.num_rows else df for n, df in found.items()}

    def catalog(self, spark: SparkSession) -> list[catalog.TableDef]:
        """What the store itself says of its tables; empty for stores of files and documents."""
        return catalog.table_defs(CATALOGS[self.kind](spark, self)) if self.kind in CATALOGS else []


# --- building sources --------------------------------------------------------------------


def _checked(what: str, value: str | None, forbidden: str, spaces: bool = False) -> str:
    if value is None or not value.strip():
        raise SourceError(f"{what} is missing")
    if any(c in forbidden or (c.isspace() and not spaces) for c in value):
        raise SourceError(f"{what} holds characters it can't have")
    return value


def url_encode(text: str) -> str:
    """Percent signs for all but letters, digits and -_.~"""
    return "".join(c if c.isalnum() or c in "-_.~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _login(user: str | None, password: str | None) -> dict[str, str]:
    return {"user": _checked("user", user, "", True), "password": _checked("password", password, "", True)}


def _port(port: int) -> int:
    if not 0 < port < 65536:
        raise SourceError("port is 1 to 65535")
    return port


def mysql(host: str, database: str, user: str, password: str, port: int = 3306, num_rows: int | None = SAMPLE_ROWS) -> Source:
    url = f"jdbc:mysql://{_checked('host', host, '@/')}:{_port(port)}/{_checked('database', database, '/' + chr(92))}"
    return Source("mysql", url, num_rows, options=_login(user, password))


def postgresql(host: str, database: str, user: str, password: str, namespace: str = "public", port: int = 5432, num_rows: int | None = SAMPLE_ROWS) -> Source:
    url = f"jdbc:postgresql://{_checked('host', host, '@/')}:{_port(port)}/{_checked('database', database, '/' + chr(92))}"
    return Source("postgresql", url, num_rows, options=_login(user, password) | {"namespace": _checked("namespace", namespace, "@/" + chr(92))})


def mongodb(host: str, database: str, user: str, password: str, collections: str | None = None, port: int = 27017, num_rows: int | None = SAMPLE_ROWS) -> Source:
    login = _login(user, password)
    uri = f"mongodb://{url_encode(login['user'])}:{url_encode(login['password'])}@{_checked('host', host, '@/')}:{_port(port)}"
    return Source("mongodb", uri, num_rows, options={"database": _checked("database", database, "/" + chr(92))} | ({"collections": collections} if collections else {}))


def sqlite(path: str, num_rows: int | None = SAMPLE_ROWS) -> Source:
    if not os.path.exists(path):
        raise SourceError(f"no such file: {path}")
    return Source("sqlite", path, num_rows)


# --- files ---------------------------------------------------------------------------------


def files(path: str, **more) -> Source:
    """A directory of files of one kind, told by the extensions in it."""
    spark = SparkSession.getActiveSession()
    names = [n for n, _ in _entries(spark, path)]
    for kind, ends in (("parquet", (".parquet",)), ("csv", (".csv",)), ("excel", (".xlsx", ".xlsm")), ("documents", (".jsonl", ".json"))):
        if any(n.endswith(ends) for n in names):
            if kind == "parquet" and more.get("has_header"):
                raise SourceError("Parquet files have no header row")
            return Source(kind, path, **more)
    raise SourceError(f"no file that can be read in {path}")


def _entries(spark: SparkSession | None, path: str) -> list[tuple[str, str]]:
    """Names and places in a directory of any file system that Hadoop knows; without a session, of the local one."""
    if spark is None:
        if not os.path.isdir(path):
            raise SourceError(f"not a directory: {path}")
        return sorted((n, os.path.join(path, n)) for n in os.listdir(path))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise SourceError(f"not a directory: {path}")
    return sorted((x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(where))


def _listed(spark: SparkSession, source: Source, *ends: str) -> list[tuple[str, str]]:
    return [(n, p) for n, p in _entries(spark, source.location) if n.endswith(ends) and re.search(source.pattern or "", n)]


Reads = Iterator[tuple[str, Callable[[], dict[str, DataFrame]]]]


def read_parquet(spark: SparkSession, source: Source) -> Reads:
    for f, p in _listed(spark, source, ".parquet"):
        yield f, lambda f=f, p=p: {f: spark.read.parquet(p)}


def read_csv(spark: SparkSession, source: Source) -> Reads:
    """Types are inferred from the sampled rows alone."""

    def read(f: str, p: str) -> dict[str, DataFrame]:
        reader = spark.read.option("header", source.has_header).options(**source.options).option("inferSchema", True)
        first = p
        if source.num_rows is not None:
            first = spark.sparkContext.parallelize([r.value for r in spark.read.text(p).limit(source.num_rows + source.has_header).collect()], 1)
        schema = reader.csv(first).schema
        return {f.removesuffix(".csv"): spark.read.schema(schema).option("header", source.has_header).options(**source.options).csv(p)}

    for f, p in _listed(spark, source, ".csv"):
        yield f, lambda f=f, p=p: read(f, p)


def _cell_type(values: list) -> str:
    """The type that all cells share. Numbers without fractions are long; unlike cells are text."""
    seen = {type(v) for v in values if v is not None}
    if seen == {bool}:
        return "boolean"
    if seen and seen <= {int, float}:
        return "long" if all(float(v).is_integer() for v in values if v is not None) else "double"
    return {frozenset(): "void", frozenset({datetime.datetime}): "timestamp_ntz", frozenset({datetime.date}): "date", frozenset({bytes}): "binary"}.get(frozenset(seen), "string")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that mean dates and times, of those that every workbook has.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    # colours and conditions in brackets, quoted text and escaped characters say nothing
    told = lambda f: re.sub(r'"[^"]*"|[[][^]]*]|\\.', "", f.get("formatCode", "")).lower()
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", told(f))}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _place(ref: str | None, default: int) -> int:
    """The column number of a cell reference."""
    letters = re.match("[A-Z]+", ref or "")
    if not letters:
        return default
    at = 0
    for ch in letters[0]:
        at = at * 26 + ord(ch) - 64
    return at - 1


def _moment(serial: float, from_1904: bool) -> datetime.datetime:
    day = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
    return day + datetime.timedelta(milliseconds=round(serial * 86_400_000))


def _cells(row, shared: list[str], dates: set[int], from_1904: bool) -> list:
    cells: list = []
    for k, c in enumerate(row.findall(f"{_MAIN}c")):
        at = _place(c.get("r"), k)
        cells += [None] * (at + 1 - len(cells))
        kind, v = c.get("t"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        elif v is None or v.text is None or kind == "e":
            cells[at] = None
        elif kind == "s":
            cells[at] = shared[int(v.text)]
        elif kind == "b":
            cells[at] = v.text == "1"
        elif kind == "str":
            cells[at] = v.text
        elif kind == "d":
            cells[at] = datetime.datetime.fromisoformat(v.text.replace("Z", ""))
        else:
            x = float(v.text)
            cells[at] = _moment(x, from_1904) if int(c.get("s", 0)) in dates else int(x) if x.is_integer() else x
    return cells


def sheets(path: str | bytes) -> dict[str, list[list]]:
    """Rows of cells of a workbook in the open XML format: of each named table, and of each sheet that has none."""
    import io

    out: dict[str, list[list]] = {}
    with zipfile.ZipFile(io.BytesIO(path) if isinstance(path, bytes) else path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        settings = book.find(f"{_MAIN}workbookPr")
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        dates = _date_styles(z)
        for sheet in book.iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            rows: list[list] = []
            for row in ElementTree.fromstring(z.read(target)).iter(f"{_MAIN}row"):
                number = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(number - 1 - len(rows))]
                rows.append(_cells(row, shared, dates, from_1904))
            links = target.replace("worksheets/", "worksheets/_rels/") + ".rels"
            tables = [r.get("Target") for r in ElementTree.fromstring(z.read(links)) if r.get("Type", "").endswith("/table")] if links in names else []
            for t in tables:
                root = ElementTree.fromstring(z.read(os.path.normpath(os.path.join("xl/worksheets", t)).lstrip("/")))
                first, last = (re.match(r"\$?([A-Z]+)\$?(\d+)", x) for x in root.get("ref").split(":"))
                a, b = _place(first[1], 0), _place(last[1], 0) + 1
                out[root.get("name")] = [(r + [None] * b)[a:b] for r in rows[int(first[2]) - 1 : int(last[2])]]
            if not tables:
                out[sheet.get("name")] = [r for r in rows if r]
    return out


#: What a value must be for a column of a type; anything else is null, as is what doesn't fit.
_COERCE: dict[str, Callable] = {
    "long": lambda v: int(v) if isinstance(v, (int, bool)) and -(2**63) <= v < 2**63 else int(v) if isinstance(v, float) and v.is_integer() else None,
    "double": lambda v: float(v) if isinstance(v, (int, float, decimal.Decimal)) else None,
    "boolean": lambda v: v if isinstance(v, bool) else v != 0 if isinstance(v, int) else None,
    "string": lambda v: v if isinstance(v, str) else v.hex() if isinstance(v, bytes) else str(v),
    "binary": lambda v: v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else None,
    "date": lambda v: v.date() if isinstance(v, datetime.datetime) else v if isinstance(v, datetime.date) else None,
    "timestamp_ntz": lambda v: v if isinstance(v, datetime.datetime) else datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 10**11 else None,
    "void": lambda v: None,
}


def coerced(values: list, kind: str) -> list:
    """Values for a column of this type: those of another kind, and numbers out of range, are null. Texts for numbers, dates, times and decimals are left to Spark's parsers (`typed`)."""
    return [None if v is None else _COERCE[kind](v) for v in values]


def typed(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Text columns as these logical types, by closed lists of formats; what doesn't parse or fit is null."""
    from ..functions import expressions as X

    out = []
    for c in df.columns:
        kind, col = wanted.get(c), F.col(f"`{c}`")
        if kind is None or kind == "Utf8":
            out.append(col)
            continue
        physical = catalog.spark_type(kind)
        if kind.startswith("Timestamp"):
            value = F.coalesce(X.to_timestamp(col), X.to_date(col).cast("timestamp_ntz"))
        elif kind == "Date32":
            value = F.coalesce(X.to_date(col), X.to_timestamp(col).cast("date"))
        elif kind.startswith(("Time32", "Time64")):
            value = X.to_time(col)
        elif kind == "FixedSizeBinary(16)":
            value = X.to_uuid(col)
        elif kind == "Boolean":
            value = F.when(col.isin(X.TRUE_WORDS), True).when(col.isin(X.FALSE_WORDS), False)
        elif kind.startswith("List"):
            value = F.from_json(col, physical)
        else:
            value = col.try_cast(physical)
        out.append(value.alias(c))
    return df.select(*out)


def _frame(spark: SparkSession, names: list[str], rows: list[list], kinds: list[str | None] | None = None) -> DataFrame:
    width = len(names)
    rows = [(r + [None] * width)[:width] for r in rows]
    kinds = [k or _cell_type([r[i] for r in rows]) for i, k in enumerate(kinds or [None] * width)]
    columns = [coerced([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    schema = StructType([StructField(n, StructType.fromDDL(f"x {k}")[0].dataType) for n, k in zip(names, kinds)])
    return spark.createDataFrame(list(zip(*columns)) if rows else [], schema)


def read_excel(spark: SparkSession, source: Source) -> Reads:
    """Named tables, or whole sheets: a workbook is one file on one machine, so it is read by the driver."""

    def read(f: str, p: str) -> dict[str, DataFrame]:
        out = {}
        raw = bytes(spark.read.format("binaryFile").load(p).select("content").first()[0])
        for name, rows in sheets(raw).items():
            if rows:
                head = [str(h) if h is not None else f"column_{k}" for k, h in enumerate(rows[0])] if source.has_header else [f"column_{k}" for k in range(max(map(len, rows)))]
                body = rows[1:] if source.has_header else rows
                out[f"{f.rsplit('.', 1)[0]}.{name}"] = _frame(spark, head, body[: source.num_rows])
        return out

    for f, p in _listed(spark, source, ".xlsx", ".xlsm"):
        yield f, lambda f=f, p=p: read(f, p)


# --- databases -----------------------------------------------------------------------------


#: SQLite's declared types by what they contain, as its own affinity rules read them.
_AFFINITY = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"))
#: Rows that the driver holds at a time when a whole SQLite table is read.
SQLITE_ROWS = 50_000


def _sqlite(source: Source) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{source.location}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_catalog(spark: SparkSession, source: Source) -> list[catalog.SourceField]:
    with _sqlite(source) as db:
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return [catalog.from_pragma(source.silo_id, t, r[1], r[2], r[3], r[4]) for t in tables for r in db.execute(f"PRAGMA table_info({_quoted(t)})")]


def read_sqlite(spark: SparkSession, source: Source) -> Reads:
    """Declared types decide where all values fit them; else the values do. A whole table is read in slices of rows by the executors, which must see the file."""
    columns = sqlite_catalog(spark, source)

    def read(table: str) -> dict[str, DataFrame]:
        declared = {c.column_name: c.data_type.upper() for c in columns if c.table_name == table}
        with _sqlite(source) as db:
            rows = [list(r) for r in db.execute(f"SELECT * FROM {_quoted(table)} LIMIT {source.num_rows or SQLITE_ROWS}")]
            total = db.execute(f"SELECT count(*) FROM {_quoted(table)}").fetchone()[0] if source.num_rows is None else len(rows)
        kinds = []
        for k, kind in enumerate(declared.values()):
            want = next((t for part, t in _AFFINITY if part in kind), None)
            values = [r[k] for r in rows if r[k] is not None]
            kinds.append(want if want and all(v is not None for v in coerced(values, want)) else None)
        frame = _frame(spark, list(declared), rows, kinds)
        return {table: _sliced(spark, source, table, frame.schema, total) if total > len(rows) else frame}

    for t in sorted({c.table_name for c in columns}):
        yield t, lambda t=t: read(t)


def _sliced(spark: SparkSession, source: Source, table: str, schema: StructType, total: int) -> DataFrame:
    kinds = [f.dataType.simpleString().replace("bigint", "long") for f in schema]

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                with _sqlite(source) as db:
                    rows = db.execute(f"SELECT * FROM {_quoted(table)} LIMIT {SQLITE_ROWS} OFFSET {start}").fetchall()
                yield pa.RecordBatch.from_arrays([pa.array(coerced([r[i] for r in rows], k), arrow.field(i).type) for i, k in enumerate(kinds)], schema=arrow)

    starts = spark.range(0, total, SQLITE_ROWS, numPartitions=-(-total // SQLITE_ROWS))
    return starts.mapInArrow(read, schema)


def _jdbc(spark: SparkSession, source: Source, table: str) -> DataFrame:
    login = {k: v for k, v in source.options.items() if k != "namespace"}
    return spark.read.format("jdbc").option("url", source.location).option("dbtable", table).options(**login).load()


def catalog_query(source: Source) -> str:
    """What is asked of the database's own catalog."""
    mine = "DATABASE()" if source.kind == "mysql" else "'" + source.options.get("namespace", "public").replace("'", "''") + "'"
    columns = ["table_schema", "table_name", "column_name", "column_default", "is_nullable", "data_type", "numeric_precision", "numeric_scale", "datetime_precision", "character_maximum_length", "column_type" if source.kind == "mysql" else "udt_name"]
    return f"(SELECT {', '.join(f'{c} AS {c}' for c in columns)}, ordinal_position AS ordinal_position FROM information_schema.columns WHERE table_schema = {mine}) q"


def jdbc_catalog(spark: SparkSession, source: Source) -> list[catalog.SourceField]:
    udt = "column_type" if source.kind == "mysql" else "udt_name"
    return [catalog.from_information_schema(source.silo_id, r.asDict(), udt) for r in _jdbc(spark, source, catalog_query(source)).orderBy("table_name", "ordinal_position").collect()]


def read_jdbc(spark: SparkSession, source: Source) -> Reads:
    """Tables of a MySQL or PostgreSQL schema; needs the driver's jar. LIMIT is pushed down."""
    mark = "`" if source.kind == "mysql" else '"'
    name = lambda *parts: ".".join(mark + p.replace(mark, mark * 2) + mark for p in parts)
    for t in source.catalog(spark):
        yield t.name, lambda t=t: {t.name: _jdbc(spark, source, name(t.name) if source.kind == "mysql" else name(t.table_schema, t.name))}


# --- documents -----------------------------------------------------------------------------


def document_fields(documents: list[dict]) -> dict[str, str]:
    """Logical types of the documents' fields, in order of their first appearance; keys are trimmed and in lower case, types merged over the documents."""
    out: dict[str, str] = {}
    for d in documents:
        for k, v in d.items():
            key = k.strip().lower()
            out[key] = merged_type(out[key], document_type(v)) if key in out else document_type(v)
    return out


def read_documents(spark: SparkSession, source: Source) -> Reads:
    """Collections exported as JSON lines, one file each. The sampled documents make the schema; values of another kind are null."""

    def read(f: str, p: str) -> dict[str, DataFrame]:
        lines = spark.read.text(p).where("trim(value) <> ''")
        first = [json.loads(r.value) for r in lines.limit(source.num_rows or 1000).collect()]
        kinds = document_fields(first)
        if not kinds:
            return {}
        spelled = {k.strip().lower(): k for d in first for k in d}
        # every value is read as text, then cast: a value of another kind costs its own cell only
        raw = StructType([StructField(spelled[k], StringType()) for k in kinds])
        out = []
        for k, kind in kinds.items():
            cell, t = F.col("d").getField(spelled[k]), catalog.spark_type(kind)
            plain = kind in ("Utf8", "Null") or kind.startswith("Struct")
            out.append((F.from_json(cell, t) if kind.startswith("List") else cell if plain else cell.try_cast(t)).alias(k))
        return {f.rsplit(".", 1)[0]: lines.select(F.from_json("value", raw).alias("d")).select(*out)}

    for f, p in _listed(spark, source, ".jsonl", ".json"):
        yield f, lambda f=f, p=p: read(f, p)


def read_mongo(spark: SparkSession, source: Source) -> Reads:
    """Collections named in the options; needs the connector's jar. Exported collections are read by the kind `documents`."""
    if "database" not in source.options or "collections" not in source.options:
        raise SourceError("a MongoDB source needs the options database and collections")
    base = spark.read.format("mongodb").option("connection.uri", source.location).option("database", source.options["database"])
    for c in source.options["collections"].split(","):
        yield c, lambda c=c: {c: base.option("collection", c).load()}


CATALOGS: dict[str, Callable[[SparkSession, Source], list[catalog.SourceField]]] = {"sqlite": sqlite_catalog, "mysql": jdbc_catalog, "postgresql": jdbc_catalog}
READERS: dict[str, Callable[[SparkSession, Source], Reads]] = {"parquet": read_parquet, "csv": read_csv, "excel": read_excel, "sqlite": read_sqlite, "mysql": read_jdbc, "postgresql": read_jdbc, "documents": read_documents, "mongodb": read_mongo}
