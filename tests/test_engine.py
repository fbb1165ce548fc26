import random
import sqlite3
import uuid
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import describe, formats
from tallyloom.functions import expressions as X
from tallyloom.operators import align, cluster, fieldstats, profile, promote
from tallyloom.plans.analyzer import SchemaAnalyzer, Scoring, Similarity
from tallyloom.sources import catalog, names, stores
from tallyloom.sources.stores import Source, SourceError


@pytest.fixture(scope="module")
def typed(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        t = int(1_600_000_000 + rng.random() ** 1.3 * 3e7)
        when = datetime(2020, 1, 1) + timedelta(days=rng.randint(0, 900), seconds=rng.randint(0, 80000))
        rows.append((str(uuid.UUID(int=rng.getrandbits(128))), rng.choice(["true", "false"]), str(rng.randint(-500, 9000)), i * 7919 % 311, f"{rng.random() * 90 + 0.25:.3f}", when.strftime("%d-%m-%Y"), when.strftime("%Y-%m-%dT%H:%M:%S"), "[1,2]", '{"a": 1}', rng.choice(["0", "1"]), when.replace(hour=0, minute=0, second=0), float(i % 7), rng.randint(0, 1), None, "12:30:0" + str(i % 10)))
    names = "uuid_str string, bool_utf8 string, int64_str string, int_64 bigint, float64_str string, date32_str string, timestamp_str string, arr_str string, json_str string, zero_one_str string, midnight_ts timestamp_ntz, whole double, bit int, all_null string, time_str string"
    return spark.createDataFrame(rows, names)


WANT = {"uuid_str": promote.UUID, "bool_utf8": "Boolean", "int64_str": "Int64", "int_64": "Int64", "float64_str": "Float64", "date32_str": promote.DATE, "timestamp_str": promote.STAMP, "arr_str": promote.LIST, "json_str": "Utf8", "zero_one_str": "Float64", "midnight_ts": promote.DATE, "whole": "Int64", "bit": "Boolean", "all_null": "Utf8", "time_str": "Utf8"}


def test_promotions(typed):
    found = promote.promote(typed)
    assert {p.column: p.target for p in found} == WANT
    assert all(p.confidence in (0.86, 1.0) for p in found)
    out = promote.apply(typed, found)
    kinds = dict(out.dtypes)
    assert (kinds["uuid_str"], kinds["bool_utf8"], kinds["int64_str"], kinds["date32_str"], kinds["timestamp_str"], kinds["arr_str"], kinds["bit"], kinds["midnight_ts"]) == ("binary", "boolean", "bigint", "date", "timestamp_ntz", "array<string>", "boolean", "date")
    assert out.where(" OR ".join(f"{c} IS NULL" for c in WANT if c != "all_null")).count() == 0


def test_half_null_columns_have_no_statistics(spark):
    df = spark.createDataFrame([(None,), (1,), (None,), (0,)], "x int")
    assert promote.promote(df)[0].target == "Int64"


DAY, NOON = "2024-01-02", "2024-01-02 15:04:05"
DATES = {"2024-1-2": DAY, "20240102": DAY, "2Jan2024": DAY, "02jan2024": DAY, "24/01/02": DAY, "02-01-2024": DAY, "Tue, 02 Jan 2024": DAY, "2/Jan/2024": DAY, "Wed, 02 Jan 2024": None, "Tue, 02/Jan/2024": None, "2024-13-02": None, "2024-02-30": None, "202411": None, "x": None, "": None}
STAMPS = {
    **{t: NOON for t in ("02Jan2024PM030405", "24/01/02 15:04:05", "2024-01-02T15:04:05", "2024-01-02 15:04:05", "Tue, 02 Jan 2024 15:04:05", "02/Jan/2024:15:04:05", "20240102150405", "2024-01-02T15:04:05Z", "2024-01-02 15:04:05+02:00")},
    **{t: NOON + ".500000" for t in ("02Jan2024PM030405.5", "2024-01-02T15:04:05.5Z", "2024-01-02T15:04:05.5+02:00", "2024-01-02T15:04:05.5", "2024-01-02 15:04:05.5-0200", "Tue, 02 Jan 2024 15:04:05.5 GMT", "02/Jan/2024:15:04:05.5 +0200", "2024-01-02 15:04:05.5", "24/01/02 15:04:05.5", "20240102150405.5")},
    **{t: None for t in ("2024-01-02", "2024-01-02 25:04:05", "Mon, 02 Jan 2024 15:04:05", "2024-01-02 15:04", "")},
}
CLOCKS = {"PM030405.5": 54245500, "15:04:05.5Z": 54245500, "15:04:05.000001": 54245000, "15:04:05.5+02:00": 54245500, "15:04:05.5": 54245500, "15:04:05": 54245000, "15:04:05.5 GMT": 54245500, "15:04:05.5 +0200": 54245500, "150405.5": 54245500, "3:04 PM": 54240000, "12:00 AM": 0, "12:30": None, "13:04 PM": None, "24:00:00": None, "1504": None, "": None}


def test_formats(spark):
    for read, cases, kind in ((X.to_date, DATES, "string"), (X.to_timestamp, STAMPS, "string"), (X.to_time, CLOCKS, "long")):
        df = spark.createDataFrame([(a,) for a in cases], "s string")
        got = {r[0]: r[1] for r in df.select("s", read(F.col("s")).cast(kind)).collect()}
        want = {k: v.replace(".500000", ".5") if isinstance(v, str) else v for k, v in cases.items()}
        assert got == want
    assert len(formats.DATES) == 7 and len(formats.TIMESTAMPS) == 17
    numbers = spark.createDataFrame([("1",), (" 12 ",), ("1f",), ("1e3",), (".5",), ("",), ("1e999",)], "s string").select(X.to_number(F.col("s"))).collect()
    assert [r[0] for r in numbers] == [1.0, None, None, 1000.0, 0.5, None, None]


def test_boolean_words(spark):
    yes = "t tr tru true y ye yes on 1 1.0".split()
    assert sorted(X.TRUE_WORDS) == sorted(yes) and len(X.BOOLEAN_WORDS) == 21
    words = [*yes, "off", "of", "fals", "0.0", "True", "YES", " t", "o"]
    got = spark.createDataFrame([(w,) for w in words], "s string").select(promote.cast_column(F.col("s"), "string", "Boolean")).collect()
    assert [r[0] for r in got] == [True] * 10 + [False] * 4 + [None] * 4
    assert spark.createDataFrame([("1.0",), ("0.0",), ("1.05",)], "s string").select(X.replace_float_bool(F.col("s"))).collect() == [("1",), ("0",), ("1.05",)]


def test_rules():
    """Scales of spans, gaps of quantiles and plausible years, where a unit's rules part."""
    s = fieldstats.FieldStats("bigint", sample_size=100, min_val=0.0, max_val=5e5, quantiles=[1.0] * 11, p10=-3e9, p90=0.0, entropy=0.95, all_integers=True)
    assert promote.span_rule(s, "s") is True and promote.span_rule(s, "ms") is None and promote.span_rule(s, "us") is False
    assert promote.quantile_rule(s, "s") is None and promote.epoch_rule(s, "s") is False
    s.p10, s.p90, s.delta_gcd = -61_500.0, -1_500.0, 1000
    assert promote.epoch_rule(s, "ms") is True and promote.epoch_rule(s, "s") is False
    s.max_val = s.min_val
    assert promote.span_rule(s, "s") is None and promote.epoch_rule(s, "s") is None
    s.timestamp_bands = {"s": [0, 3, 0, 3, 0, 0]}
    assert promote.bands_rule(s, "s") is False
    assert promote.meta_for("Timestamp(ms)", s)["datetime_precision"] == 6


def test_statistics_of_any_column(spark):
    """Dates, times, decimals, bytes and truth values; half-null, all-null, empty and single-value columns."""
    rows = [(datetime(2020, 1, 1).date() + timedelta(days=i % 9), datetime(2020, 1, 1, i % 24), i, bytes(i % 3), i % 2 == 0, None, 1 if i % 2 else None, i * 1.5) for i in range(40)]
    df = spark.createDataFrame([(*r[:2], Decimal(r[2]), *r[3:]) for r in rows], "d date, t timestamp_ntz, p decimal(9,2), b binary, f boolean, n int, h int, v double")
    s = fieldstats.field_stats(df)
    assert s["d"].distinct_count == 9 and s["d"].max_val - s["d"].min_val == 8 and len(s["d"].quantiles) == 11 and s["d"].avg == -1
    assert s["t"].all_timestamp_date32 is False and s["t"].delta_gcd == 3_600_000_000 and s["t"].is_monotonic
    assert (s["p"].numeric_precision, s["p"].numeric_scale, s["p"].cardinality) == (9, 2, 1.0)
    assert (s["b"].distinct_count, s["b"].char_max_length, s["b"].signature) == (3, 2, "charclass")
    assert s["f"].entropy == 1 and s["f"].cardinality == 2 / 40 and s["f"].all_int_bools
    assert s["n"].silent and s["n"].null_count == 40 and s["h"].silent and s["h"].quantiles is None
    assert fieldstats.field_stats(df.limit(0))["v"].silent
    for kind in ("d", "t"):
        for f in (profile.moments, profile.quantiles, profile.percentiles, profile.delta_entropy, profile.histogram_entropy, profile.autocorrelation):
            assert len(f(df, kind).collect()) == 1
    assert fieldstats.is_monotonic(df, "v") and fieldstats.is_monotonic(df, "v", "p") and not fieldstats.is_monotonic(df, "d", "p")


def test_ranges_hold_distinct_values(spark, monkeypatch):
    """A column of nearly all zeros is cut by what is distinct in it."""
    monkeypatch.setattr(fieldstats, "RANGE_VALUES", 50)
    df = spark.range(5000).select(F.when(F.col("id") < 4500, 0).otherwise(F.col("id")).cast("double").alias("x"))
    rows = sorted(tuple(r) for r in profile.sorted_values(df, "x").collect())
    assert len(rows) == 501 and rows[0] == (0.0, 4500, None, 4500) and rows[-1] == (4999.0, 1, 4998.0, 5000)
    assert all(a[0] == b[2] and a[3] + b[1] == b[3] for a, b in zip(rows, rows[1:]))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], ["a", "b"], ["b", "c"]), ([0.0, 0.0], [1.0, 0.0], [], [])], "a array<double>, b array<double>, s array<string>, t array<string>")
    r = df.select(X.cosine(F.col("a"), F.col("b")), X.normalised(F.col("a")), X.jaccard(F.col("s"), F.col("t"))).collect()
    assert r[0][0] == pytest.approx(0.96) and list(r[0][1]) == pytest.approx([0.6, 0.8]) and r[0][2] == pytest.approx(1 / 3)
    assert r[1][0] == 0 and list(r[1][1]) == [0, 0] and r[1][2] == 0
    v = spark.range(1).select(X.similarity_vector(F.expr("array(named_struct('i', 1, 'sim', 0.5D), named_struct('i', 1, 'sim', 0.7D))"), 3)).first()[0]
    assert list(v) == [0.0, 0.7, 0.0]


def test_profiles_of_empty_and_single_columns(spark):
    for df in (spark.createDataFrame([], "x double"), spark.createDataFrame([(None,)], "x double"), spark.createDataFrame([(2.0,)], "x double"), spark.createDataFrame([(2.0,)] * 30, "x double")):
        for f in (profile.counts, profile.moments, profile.quantiles, profile.percentiles, profile.delta_entropy, profile.histogram_entropy, profile.autocorrelation, profile.delta_gcd, profile.number_flags):
            assert len(f(df, "x").collect()) == 1 or f is profile.delta_gcd
        profile.timestamp_bands(df, "x").collect()


def workbook(path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>flag</t></is></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2" t="b"><v>1</v></c></row><row r="3"><c r="A3"><v>2</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="x" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("k\n1.5\n")
    t = stores.files(str(tmp_path)).tables(spark)
    assert sorted(t) == ["a", "b"] and t["a"].count() == 2 and dict(t["a"].dtypes) == {"id": "int", "name": "string"}
    assert sorted(Source("csv", str(tmp_path), pattern="^a").tables(spark)) == ["a"]
    (tmp_path / "x").mkdir()
    workbook(tmp_path / "x" / "w.xlsx")
    w = stores.files(str(tmp_path / "x")).tables(spark)["w.one"]
    assert w.dtypes == [("id", "bigint"), ("column_1", "double"), ("flag", "boolean")] and [tuple(r) for r in w.collect()] == [(1, 2.5, True), (2, None, None)]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, v REAL, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, i / 2, str(i)) for i in range(30)])
    db.close()
    t = Source("sqlite", str(tmp_path / "d.db")).tables(spark)["t"]
    assert t.count() == 10 and dict(t.dtypes)["s"] == "string"
    for bad in (lambda: stores.files(str(tmp_path / "none")), lambda: Source("paper", "x").tables(spark), lambda: Source("mongodb", "x").tables(spark)):
        with pytest.raises(SourceError):
            bad()


def test_more_sources(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="x" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="str"><v>day</v></c><c r="C2" t="str"><v>n</v></c></row><row r="3"><c r="B3" s="1"><v>45293.5</v></c><c r="C3"><v>4</v></c></row><row r="4"><c r="B4" s="2"><v>45294</v></c><c r="C4" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/table" Target="../tables/table1.xml"/></Relationships>')
        z.writestr("xl/tables/table1.xml", f'<table xmlns="{main}" id="1" name="days" ref="B2:C4"/>')
    t = Source("excel", str(tmp_path)).tables(spark)
    assert list(t) == ["w.days"] and t["w.days"].dtypes == [("day", "timestamp_ntz"), ("n", "bigint")]
    assert [tuple(r) for r in t["w.days"].collect()] == [(datetime(2024, 1, 2, 12), 4), (datetime(2024, 1, 3), None)]

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "people.jsonl").write_text('{"Name ": "a", "age": 3, "tags": ["x"], "at": null}\n{"Name ": "b", "age": 4.5, "tags": [], "at": "y"}\n{"Name ": "c", "age": "old"}\n')
    d = stores.files(str(docs)).tables(spark)["people"]
    assert d.columns == ["name", "age", "tags", "at"] and [tuple(r) for r in d.select("name", "tags").collect()][:2] == [("a", ["x"]), ("b", [])]
    narrow = Source("documents", str(docs), 2).tables(spark)["people"]
    assert dict(narrow.dtypes)["age"] == "double" and [r.age for r in Source("documents", str(docs), 2).tables(spark)["people"].collect()] == [3.0, 4.5]

    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER NOT NULL, name VARCHAR(20) DEFAULT 'x', raw BLOB, mixed INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, str(i), b"\x01", "z" if i == 3 else i) for i in range(25)])
    db.close()
    source = stores.sqlite(path)
    (table,) = source.catalog(spark)
    assert [(f.name, f.canonical_type, f.is_nullable, f.column_default) for f in table.fields] == [("id", "Int32", False, None), ("name", "Utf8", True, "'x'"), ("raw", "Binary", True, None), ("mixed", "Int32", True, None)]
    t = source.tables(spark)["t"]
    assert t.dtypes == [("id", "bigint"), ("name", "string"), ("raw", "binary"), ("mixed", "string")] and bytes(t.first().raw) == b"\x01"
    whole = stores.sqlite(path, None)
    old, stores.SQLITE_ROWS = stores.SQLITE_ROWS, 7
    try:
        assert sorted(r.id for r in whole.tables(spark)["t"].collect()) == list(range(25))
    finally:
        stores.SQLITE_ROWS = old


def test_validators():
    good = dict(host="db", database="shop", user="me", password="p w")
    assert stores.mysql(**good).location == "jdbc:mysql://db:3306/shop"
    assert "user" in stores.postgresql(**good, namespace="own").options and stores.mongodb(**good | {"password": "a@b"}).location == "mongodb://me:a%40b@db:27017"
    for k, v in (("host", "a b"), ("host", ""), ("database", "a/b"), ("user", " "), ("password", ""), ("port", 0), ("num_rows", 0)):
        with pytest.raises(SourceError):
            stores.mysql(**good | {k: v})
    with pytest.raises(SourceError):
        stores.postgresql(**good, namespace="a@b")
    with pytest.raises(SourceError):
        stores.sqlite("/no/such/file")
    assert stores.url_encode("a:/ é-") == "a%3A%2F%20é-"
    assert Source("csv", "/a", pattern="x").silo_id != Source("csv", "/a").silo_id == Source("csv", "/a", 5).silo_id
    assert "o''x" in stores.catalog_query(Source("postgresql", "u", options={"namespace": "o'x"}))


def test_catalogs():
    row = {"table_schema": b"shop", "table_name": b"t", "column_name": b"price", "column_default": None, "is_nullable": b"NO", "data_type": b"decimal", "column_type": b"decimal", "numeric_precision": 9, "numeric_scale": 2, "datetime_precision": None, "character_maximum_length": 2**40}
    c = catalog.from_information_schema("s", row, "column_type")
    assert (c.column_name, c.is_nullable, c.char_max_length) == ("price", False, 2**31 - 1)
    t, = catalog.table_defs([c])
    assert t.fields[0].canonical_type == "Decimal128(9, 2)" and t.fields[0].type_confidence == 0.98 and t.rep().fields == [t.fields[0].id]
    assert catalog.physical_schema(t).simpleString() == "struct<price:decimal(9,2)>"
    assert catalog.spark_type("List(Utf8)").simpleString() == "array<string>" and catalog.spark_type("Time32(ms)").simpleString() == "bigint"
    assert catalog.signature("charclass", [0.2] * 5)[0] == "charclass" and catalog.signature("numeric") == ("numeric", None)
    for bad in (("nothing", None), ("numeric", [1.0] * 5), ("charclass", [1.0])):
        with pytest.raises(ValueError):
            catalog.signature(*bad)


def test_texts_as_types(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-02", "2024-01-02T03:04:05", "1.5", "on"), ("9999999999", "2", "02 Jan", "24/01/02", "z", "True")], "a string, b string, c string, d string, e string, f string")
    got = stores.typed(df, {"a": "Int32", "b": "Int64", "c": "Date32", "d": "Timestamp(us)", "e": "Decimal128(9, 2)", "f": "Boolean"}).collect()
    assert [tuple(map(str, r)) for r in got] == [("1", "None", "2024-01-02", "2024-01-02 03:04:05", "1.50", "True"), ("None", "2", "None", "2024-01-02 00:00:00", "None", "None")]
    assert stores.coerced([1, 2.5, True, "x", 2**70, None], "long") == [1, None, 1, None, None, None]


def test_type_names():
    plain = {"tinyint": "Int8", " BIGINT ": "Int64", "jsonb": "LargeBinary", "uuid": "FixedSizeBinary(16)", "varchar(255)": "Utf8", "double": "Float64", "numeric": "Decimal128(38, 10)"}
    assert {k: stores.canonical_type(k) for k in plain} == plain
    parsed = {"Timestamp(Millisecond, None)": "Timestamp(ms)", "decimal128(9, 2)": "Decimal128(9, 2)", "LIST(int4)": "List(Int32)", "time64(us)": "Time64(us)", "timestamp(x)": "Utf8", "list(int": "Utf8"}
    assert {k: stores.canonical_type(k) for k in parsed} == parsed
    assert names.document_type([1, None, 2**40]) == "List(Int64)" and names.document_type({"a": 1}).startswith("Struct") and stores.document_fields([{" A": 1}, {"a ": 2.5}]) == {"a": "Float64"}
    assert stores.canonical_type("time", 0) == "Time32(s)" and stores.canonical_type("timestamp", 3) == "Timestamp(ms)"
    assert stores.merged_type("Int32", "Float64") == "Float64" and stores.merged_type("Int64", "Float64") == "Utf8" and stores.merged_type("List(Null)", "List(Int32)") == "List(Int32)"


def test_paragraphs_and_vectors():
    stats = fieldstats.FieldStats("double", sample_size=9, min_val=1.0, max_val=2.5, avg=2.0, cardinality=0.95, skewness=0.5, kurtosis=-0.5, is_monotonic=True, quantiles=[float(i) for i in range(11)])
    a, b = describe.paragraph("Float64", 0.9, True, stats, default="7", numeric_precision=9), describe.paragraph("Timestamp(ms)", 0.5, False, None)
    for part in ("measured number stored as Float64", "smallest 1, P10 0, P25 2, median 5, P75 7, P90 10, largest 2.5", "Nearly every", "a sequence", "may be missing", "default is '7'", "size 2.", "9 digits", "leans right", "Outliers are rare"):
        assert part in a
    assert b == "It may be a moment in time, resolved to milliseconds. No value may be missing."
    shares = {"numeric codes": [0.9, 0, 0, 0.1, 0], "alphanumeric": [0.6, 0.4, 0, 0, 0], "labels": [0, 0.9, 0, 0.1, 0], "free text": [0, 0.8, 0.2, 0, 0], "escaped": [0, 0.4, 0, 0, 0.6], "encoded": [0.2, 0.4, 0, 0, 0.4], "dates": [0.6, 0, 0, 0.4, 0], "sparse": [0.2, 0.2, 0.6, 0, 0], "No kind": [0.3, 0.3, 0.2, 0.2, 0]}
    assert all(k in describe.char_class_sentence(v) for k, v in shares.items())
    (x, y) = describe.hashed([a, a])
    assert x == y and sum(v * v for v in x) == pytest.approx(1)


def test_analysis(spark, tmp_path, sf):
    for silo in ("one", "two"):
        for t in ("nation", "supplier", "part"):
            spark.read.parquet(f"{sf}/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / silo / f"{t}.parquet"))
    (tmp_path / "two" / "broken.parquet").write_text("no")
    sources = [Source("parquet", str(tmp_path / s), 100) for s in ("one", "two")]
    analyzer = SchemaAnalyzer(spark, sources, Similarity(0.55), persist_path=str(tmp_path / "store"))
    report = analyzer.analyze()
    assert report.stats.tables_inferred == 6 and len(report.stats.errors) == 1
    groups = [sorted(t.split(".", 1)[1] for t in c.tables) for c in report.clusters]
    assert all(g == [g[0]] * 2 for g in groups) and len(groups) == 3
    assert all(len(f["fields"]) == 2 for c in report.clusters for f in c.field_clusters)
    store = analyzer.latent_store
    assert store.frame("field_def").count() == report.stats.fields_inferred == 26
    (rep, *_) = store.table_reps()
    own = store.field_defs([rep.id])
    assert sorted(f.id for f in own) == sorted(rep.fields) and rep.num_fields == len(own) and "confidence" in str(own[0])
    assert store.search([rep.id], 2).count() == 2 and store.search([rep.id], 2, other_silos=True).count() >= 1
    store.clear()
    assert store.table_reps() == [] and store.frame("field_def").count() == 0
    for wrong in (lambda: SchemaAnalyzer(spark, sources[:1]), lambda: SchemaAnalyzer(spark, sources, threads=0), lambda: Scoring(0.5, 0.2)):
        with pytest.raises(SourceError):
            wrong()


def test_clusters_need_both_measures(spark):
    """Tables that match other fields of the query are apart although both match the query itself."""
    rows = [("q", "a", 0, 0, 0.9), ("q", "a", 1, 1, 0.9), ("q", "b", 2, 0, 0.9), ("q", "b", 3, 1, 0.9)]
    fields = spark.createDataFrame([("q", i) for i in range(4)], "table_id string, field int")
    ordinals = fields.select("table_id", "field", F.col("field").alias("ordinal"))
    members = cluster.with_query(spark.createDataFrame(rows, "q_table string, c_table string, q_field int, c_field int, similarity double"), fields)
    v = cluster.similarity_vectors(members, ordinals)
    assert {r.table_id: list(r.vector) for r in v.collect()}["a"] == [0.9, 0.9, 0.0, 0.0]
    assert cluster.edges(v, 0.55).count() == 0 and cluster.edges(v, 0.4).count() == 2
    groups = cluster.components(v, cluster.edges(v, 0.4))
    assert {r.group for r in groups.collect()} == {"a"}
    scores = spark.createDataFrame([("q", "a", 0.8, 0.5), ("q", "b", 0.6, 0.5)], "q_table string, c_table string, score double, q_coverage double")
    t, f = cluster.clusters(members, scores, groups)
    assert t.first().confidence == pytest.approx(0.8) and {round(r.confidence, 6) for r in f.collect()} == {round(0.95 * 2 / 3, 6)}
    twice = cluster.deduplicated(t.unionAll(t), f)
    assert twice.count() == 1


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    whole = sorted(map(str, align.nearest(df, df, 4).collect()))
    monkeypatch.setattr(align, "BLOCK", 7)
    assert sorted(map(str, align.nearest(df, df, 4).collect())) == whole
    assert align.nearest(df.limit(0), df, 4).collect() == []
