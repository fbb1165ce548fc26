"""Statistics of all columns from counts in order: how often the input is read, and results where ranges, pieces and rows are cut."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.operators import align, fieldstats, promote


def counted_reads(spark, rows, schema):
    """A frame over rows, and how many of its rows have been read so far."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), read


def test_input_is_read_a_few_times(spark):
    """Twice for numbers, once more for the cardinality of texts and for the first rows; votes on numbers need one pass."""
    n = 4000
    df, read = counted_reads(spark, [(i, i * 0.5, f"t{i}") for i in range(n)], "a bigint, x double, t string")
    s = fieldstats.field_stats(df)
    assert s["a"].distinct_count == n and s["t"].cardinality == 1.0 and read.value <= 4 * n
    df, read = counted_reads(spark, [(i * 0.5, f"t{i}") for i in range(n)], "x double, t string")
    assert [p.target for p in promote.promote(df)] == ["Float64", "Utf8"] and read.value <= 2 * n


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fieldstats, "RANGE_VALUES", 40)
    rng = random.Random(5)
    rows = [(rng.choice([0.0, -0.0, rng.randint(-300, 300), rng.random() * 9]), rng.randint(0, 500), "é" * rng.randint(0, 3) + "7") for _ in range(3000)]
    s = fieldstats.field_stats(spark.createDataFrame([(float(x), i, t) for x, i, t in rows], "x double, i bigint, t string").repartition(5))
    for name, at in (("x", 0), ("i", 1)):
        v = np.sort(np.array([r[at] for r in rows], float) + 0.0)
        d, deltas, f = v - v.mean(), np.diff(v), s[name]
        assert f.distinct_count == len(np.unique(v)) and (f.min_val, f.max_val) == (v[0], v[-1])
        assert np.allclose(f.quantiles, np.quantile(v, np.arange(1, 12) / 12)) and (f.p10, f.p90) == (v[300], v[2700])
        assert math.isclose(f.avg, v.mean(), abs_tol=1e-9) and math.isclose(f.autocorrelation, (d[1:] * d[:-1]).sum() / (d * d).sum())
        n = np.unique(deltas, return_counts=True)[1]
        h = -(n / n.sum() * np.log2(n / n.sum())).sum() / np.log2(len(n))
        assert math.isclose(f.entropy, h * f.distinct_count / len(v))
        assert math.isclose(f.skewness, len(v) / ((len(v) - 1) * (len(v) - 2)) * (d**3).sum() / (d * d).mean() ** 1.5, abs_tol=1e-9)
    accents = sum(len(t) - 1 for *_, t in rows)
    assert np.allclose(s["t"].char_classes, np.array([len(rows), accents, 0, 0, 0]) / (len(rows) + accents)) and s["i"].delta_gcd == 1


def test_flags_need_every_row(spark):
    """A flag that holds for the first thousand rows fails by a later one; leading nulls prove nothing."""
    rows = [(str(i), None, "2024-01-02") for i in range(1500)] + [("x", "7", "2024-01-03")]
    s = fieldstats.field_stats(spark.createDataFrame([*rows, *[("1", "8", "2024-01-04")] * 1600], "a string, b string, c string").coalesce(1))
    assert s["a"].all_floats is False and s["a"].all_integers is None
    assert s["b"].all_floats and s["b"].all_integers and s["c"].all_date32 and not s["c"].all_time


def test_pieces_join_equal_values(monkeypatch):
    monkeypatch.setattr(fieldstats, "PIECE", 4)
    k, v, n = [0] * 9 + [1] * 3, [1.0] * 5 + [2.0, 3.0, np.nan, np.nan, 1.0, 1.0, 4.0], list(range(1, 13))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 3]) for x in (k, v, n)], ["k", "v", "n"]) for i in range(0, 12, 3)]
    out = [x for piece in fieldstats._pieces(batches) for x in zip(*(p.tolist() for p in piece))]
    assert [(a, repr(b), c) for a, b, c in out] == [(0, "1.0", 15), (0, "2.0", 6), (0, "3.0", 7), (0, "nan", 17), (1, "1.0", 21), (1, "4.0", 12)]


def test_characters_are_not_cut(monkeypatch):
    monkeypatch.setattr(fieldstats, "HELD", 3)
    texts = pa.array(["aé", "", "€x", "😀z", "plain"])
    assert "".join(chr(c) for x in fieldstats._characters(texts.slice(1), True) for c in x) == "€x😀zplain"
    assert sum(len(x) for x in fieldstats._characters(texts.cast(pa.binary()), False)) == sum(len(t.as_py().encode()) for t in texts)


def test_bounds_by_two_levels(spark):
    for n in (1, 2, 5, 17, 100):
        bounds = [float(3 * i) for i in range(n)]
        df = spark.createDataFrame([(float(x) / 2,) for x in range(-4, 6 * n + 4)], "v double").select("v", fieldstats._below(bounds).alias("got"))
        assert all(r.got == sum(b < r.v for b in bounds) for r in df.collect())


def test_nearest_holds_few_similarities(spark, monkeypatch):
    """A pair of full blocks takes tens of MB, not hundreds; blocks in pairs give the same as all at once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 16)).astype(np.float32)
    block = lambda name: pa.table({f"{name}_ids": pa.array([list(range(len(x)))]), f"{name}_flat": pa.array([x.ravel()])})
    target = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])
    left, right = block("q"), block("i")
    tracemalloc.start()
    found = align._best(left, right, 2, target)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert found["query_id"][::2].to_pylist() == found["item_id"][::2].to_pylist() == list(range(4096))
    monkeypatch.setattr(align, "BLOCK", 30)
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:200])], "id int, vector array<float>")
    got = {(r.query_id, r["rank"]): r.item_id for r in align.nearest(few.where("id % 3 = 0"), few, 3).collect()}
    unit = x[:200].astype(float) / np.linalg.norm(x[:200].astype(float), axis=1)[:, None]
    want = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :3]
    assert got == {(i, j + 1): int(want[i, j]) for i in range(0, 200, 3) for j in range(3)}
