"""All statistics of all columns of a table, in a fixed number of jobs whatever the number of columns.

Counts of values and flags of texts come from one pass. All else works on one long frame (column number, value, how often):
each task counts what it meets, the counts are kept on disk, shuffled into ranges and put in order there, so no column is ordered in one task, and the
input is read once for it. The ranges are then walked through in pieces, when it is known how many values come before each.
Numbers, dates and times are ordered by value, texts and binaries by their byte lengths.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import expressions as X
from . import profile as P

#: Distinct values that one range should hold, and how many ranges a column has at most.
RANGE_VALUES, MOST_RANGES = 1 << 17, 1024
LEAST_FOR_QUANTILES = 20
#: Rows (of characters: bytes) that a task counts at a time, and rows in order that it looks at together.
HELD, PIECE = 1 << 20, 1 << 17
#: The characters of column k are counted as values of column k + LETTERS.
LETTERS = 1 << 16
#: Rows in which a flag of a text may fail before the whole table is looked at, and these flags.
FIRST_ROWS = 1000
FLAGS = ("all_array", "all_json", "all_floats", "all_integers", "all_uuid", "all_utf8_bools", "all_date32", "all_timestamp", "all_time")


@dataclass
class FieldStats:
    """What is known of a column's values; what doesn't apply to its type keeps the first value."""

    source: str
    sample_size: int = 0
    null_count: int = 0
    is_null: bool = False
    null_ratio: float = 0.0
    cardinality: float | None = None
    distinct_count: int = 0
    avg: float = -1.0
    median: float = 0.0
    min_val: float | None = None
    max_val: float | None = None
    char_min_length: int | None = None
    char_max_length: int | None = None
    numeric_precision: int | None = None
    numeric_scale: int | None = None
    datetime_precision: int | None = None
    quantiles: list[float] | None = None
    p10: float | None = None
    p90: float | None = None
    delta_gcd: int | None = None
    entropy: float = 0.0
    kurtosis: float | None = None
    skewness: float | None = None
    histogram_entropy: float | None = None
    autocorrelation: float | None = None
    is_monotonic: bool = False
    all_int_bools: bool | None = None
    all_integers: bool | None = None
    all_floats: bool | None = None
    all_array: bool | None = None
    all_json: bool | None = None
    all_time: bool | None = None
    all_date32: bool | None = None
    all_timestamp: bool | None = None
    all_uuid: bool | None = None
    all_utf8_bools: bool | None = None
    timestamp_bands: dict[str, list[int]] = field(default_factory=dict)
    all_timestamp_date32: bool | None = None
    signature: str = "opaque"
    char_classes: list[float] | None = None

    @property
    def silent(self) -> bool:
        """Whether only counts are known: without values, and (a quirk that is kept) with exactly as many nulls as values."""
        return self.sample_size == 0 or self.sample_size == self.null_count


def group_of(kind: str) -> str:
    """number, date, stamp, boolean, text, binary, or other."""
    if kind in P.NUMERIC or kind.startswith("decimal"):
        return "number"
    if kind.startswith("timestamp"):
        return "stamp"
    return {"date": "date", "boolean": "boolean", "string": "text", "binary": "binary"}.get(kind, "other")


SIGNATURES = {"number": "numeric", "date": "temporal", "stamp": "temporal", "boolean": "bool", "text": "charclass", "binary": "charclass", "other": "opaque"}
MONOTONIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp", "decimal", "date")


def monotonic(kind: str, rows: int) -> bool:
    """The reference's rule: values are in order before they are looked at, so the type and the number of rows decide alone."""
    return rows >= 2 and kind.startswith(MONOTONIC)


def is_monotonic(df: DataFrame, column: str, order: str | None = None) -> bool:
    """Whether a column never falls: by the reference's rule; or, with the name of an order column, of the rows in that order.

    In that order ranges of rows are looked at side by side: a range must not fall within, nor below the range before it.
    """
    kind = dict(df.dtypes)[column]
    if order is None:
        return monotonic(kind, len(df.select(column).take(2)))
    v = P.value(df, column)
    rows = df.where(v.isNotNull()).select(F.col(order).alias("o"), v.alias("v"))
    parts = rows.repartitionByRange("o").withColumn("p", F.spark_partition_id())
    inside = Window.partitionBy("p").orderBy("o", "v")
    steps = parts.withColumn("before", F.lag("v").over(inside))
    each = steps.groupBy("p").agg(F.min("o").alias("o"), F.bool_and(F.coalesce(F.col("v") >= F.col("before"), F.lit(True))).alias("up"), F.min_by("v", F.struct("o", "v")).alias("first"), F.max_by("v", F.struct("o", "v")).alias("last"))
    last = None
    for r in each.orderBy("p").collect():  # one row a range
        if not r.up or (last is not None and r["first"] < last):
            return False
        last = r["last"]
    return True


def _wide(df: DataFrame, kinds: dict[str, str], votes: bool) -> tuple[int, list[dict]]:
    """The number of rows, and of each column its number of values, what all of its texts look like, and what truth values hold.

    A flag says that something holds of every value, so where it fails among the first rows it fails: over the whole table only those
    flags are taken that are still open. votes: also lengths of texts and flags of numbers, of columns that aren't put in order.
    """
    texts = [c for c, kind in kinds.items() if group_of(kind) == "text"]
    failed: dict[str, list[str]] = {c: [] for c in texts}
    if texts:
        wanted = [F.struct(F.count(f"x{i}").alias("n"), *(F.expr(sql).alias(name) for name, sql in _flags(f"x{i}").items())).alias(f"c{i}") for i in range(len(texts))]
        first = df.select(*(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(texts))).limit(FIRST_ROWS).agg(*wanted).first()
        failed = {c: [name for name in FLAGS if r.n and not r[name]] for c, r in zip(texts, first)}
    values, wanted = [], []
    for k, (c, kind) in enumerate(kinds.items()):
        col, group, x = F.col(f"`{c}`"), group_of(kind), f"x{k}"
        more: dict[str, str] = {}
        values.append((P.value_of(kind, col) if group == "number" else col if group in ("text", "boolean", "stamp") else F.when(col.isNotNull(), True)).alias(x))
        if group == "boolean":
            more = {"min": f"min(cast({x} AS int))", "max": f"max(cast({x} AS int))", "yes": f"count_if({x})"}
        elif group == "text":
            more = {name: "false" if name in failed[c] or name == "all_integers" and "all_floats" in failed[c] else sql for name, sql in _flags(x).items()}
            if votes:
                more |= {"char_min_length": f"min(octet_length({x}))", "char_max_length": f"max(octet_length({x}))"}
        elif votes and group == "number":
            more = P.number_flag_sql(x)
        elif votes and group == "stamp":
            more = {"all_timestamp_date32": f"coalesce(bool_and({x} = cast(cast({x} AS date) AS {kind})), false)"}
        fields = {"n": f"count({x})"} | more
        wanted.append(F.expr(f"named_struct({', '.join(f"'{name}', {sql}" for name, sql in fields.items())})").alias(f"c{k}"))
    (row,) = df.select(*values).agg(F.count(F.lit(1)).alias("rows"), *wanted).collect()
    return row[0], [r.asDict() for r in row[1:]]


def _flags(x: str) -> dict[str, str]:
    return {name: sql for name, sql in P.text_sql(x).items() if name in FLAGS}


def _long(df: DataFrame, columns: list[tuple[int, Column]], name: str) -> DataFrame:
    """k and the value, for all of these columns under each other."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), c.alias(name)) for k, c in columns))
    return df.select(F.explode(pairs).alias("s")).select("s.k", f"s.{name}").where(F.col(name).isNotNull())


def _below(bounds: list[float]) -> Column:
    """How many of these bounds, in order, lie below v: first by every `step`-th of them, then by those between two."""
    step = math.isqrt(len(bounds)) + 1
    numbers = lambda those: F.array(*map(F.lit, those)).cast("array<double>")
    inside = F.array(*(numbers(bounds[i : i + step]) for i in range(0, len(bounds), step)))
    count = lambda those: F.size(F.filter(those, lambda x: x < F.col("v")))
    whole = F.greatest(count(numbers(bounds[::step])) - 1, F.lit(0))
    return F.element_at(F.transform(F.array(whole), lambda w: w * step + count(F.get(inside, w))), 1)


def ranked(counted: DataFrame, kinds: dict[int, int]) -> DataFrame:
    """k, v, n, before (the next smaller value) and upto (values up to and with this one). counted: k, v, n, each value once; kinds: distinct values of each k."""
    bounds: dict[int, list[float]] = {}
    for parts in sorted({min(MOST_RANGES, -(-n // RANGE_VALUES)) for n in kinds.values()} - {0, 1}):
        those = [k for k, n in kinds.items() if min(MOST_RANGES, -(-n // RANGE_VALUES)) == parts]
        cut = counted.where(F.col("k").isin(those)).groupBy("k").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)]).alias("b"))
        bounds |= {r.k: sorted(set(r.b)) for r in cut.collect()}
    part = F.lit(0)
    for k, b in bounds.items():
        part = F.when(F.col("k") == k, _below(b)).otherwise(part)
    values = counted.withColumn("part", part)
    inside = Window.partitionBy("k", "part").orderBy("v")
    run = values.select("k", "part", "v", "n", F.lag("v").over(inside).alias("last"), F.sum("n").over(inside).alias("run"))
    if not bounds:
        return run.select("k", "v", "n", F.col("last").alias("before"), F.col("run").alias("upto"))
    over = Window.partitionBy("k").orderBy("part")  # one row a range
    heads = values.groupBy("k", "part").agg(F.max("v").alias("top"), F.sum("n").alias("held"))
    heads = heads.select("k", "part", F.lag("top").over(over).alias("earlier"), (F.sum("held").over(over) - F.col("held")).alias("skipped"))
    return run.join(F.broadcast(heads), ["k", "part"]).select("k", "v", "n", F.coalesce("last", "earlier").alias("before"), (F.col("skipped") + F.col("run")).alias("upto"))


def _entropy(counts: list[int], base: float) -> float:
    total = sum(counts)
    return -sum(n / total * math.log(n / total) for n in counts if n) / math.log(base) if total else 0.0


# --- values in order: what runs in tasks ------------------------------------------------


def _characters(c: pa.Array, text: bool) -> Iterator[np.ndarray]:
    """The code points of an array of texts, or the bytes of an array of binaries, in pieces."""
    if not len(c):
        return
    wide = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
    ends = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1]
    if ends[0] == ends[-1]:
        return
    data = np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    at = 0
    while at < len(data):
        end = min(at + HELD, len(data))
        while text and end < len(data) and data[end] & 0xC0 == 0x80:  # no character is cut
            end += 1
        piece = data[at:end]
        yield np.frombuffer(piece.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4") if text and (piece > 127).any() else piece
        at = end


def _counter(columns: list[tuple[int, str]]):
    """For mapInArrow over these columns (number and group): k, v and n, how often a task met a value; and of k + LETTERS, how often a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {k: [] for k, _ in columns}
        letters: dict[int, np.ndarray] = {}
        rows = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for k, those in held.items():
                if those:
                    v, n = np.unique(np.concatenate(those), return_counts=True)
                    yield _batch(k, v.astype(np.float64) + 0.0, n)
                    those.clear()

        for b in batches:
            for i, (k, group) in enumerate(columns):
                c = b.column(i).drop_null()
                if group in ("text", "binary"):
                    for x in _characters(c, group == "text"):
                        n = np.bincount(x)
                        old = letters.get(k, n[:0])
                        if len(old) < len(n):
                            old, n = n, old
                        old[: len(n)] += n
                        letters[k] = old
                    c = pc.binary_length(c)
                elif group == "stamp":
                    c = c.cast(pa.timestamp("us")).view(pa.int64())
                held[k].append(np.array(c.to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows >= HELD:
                yield from counted()
                rows = 0
        yield from counted()
        for k, n in letters.items():
            at = np.flatnonzero(n)
            yield _batch(k + LETTERS, at.astype(np.float64), n[at])

    return run


def _batch(k: int, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], ["k", "v", "n"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """k, v and n of rows in order, in pieces; rows of one value become one, also where a piece ends."""
    held, rows = [], 0
    for b in batches:
        held.append([b.column(i).to_numpy() for i in range(3)])
        rows += b.num_rows
        if rows >= PIECE:
            k, v, n = _merged(held)
            if len(k) > 1:
                yield k[:-1], v[:-1], n[:-1]
            held, rows = [[k[-1:], v[-1:], n[-1:]]], 1
    if rows:
        yield _merged(held)


def _merged(held: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, v, n = (np.concatenate(x) for x in zip(*held))
    other = (k[1:] != k[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
    first = np.flatnonzero(np.append(True, other))
    return k[first], v[first], np.add.reduceat(n, first)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, v, n in _pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(n)], ["k", "v", "n"])


def _by_k(k: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(k[a]), slice(int(a), int(b))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each column in a range of values: the first and last one, how many distinct ones and values, their sum, and that of n log n."""
    found: dict[int, list] = {}
    with np.errstate(all="ignore"):
        for ks, vs, ns in _pieces(batches):
            for k, at in _by_k(ks):
                v, n = vs[at], ns[at]
                old = found.get(k, [v[0], v[-1], 0, 0, 0.0, 0.0])
                found[k] = [old[0], v[-1], old[2] + len(v), old[3] + int(n.sum()), old[4] + float((v * n).sum()), old[5] + float((n * np.log2(n)).sum())]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([r[i] for r in found.values()], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())))], ["k", "low", "top", "kinds", "held", "total", "bits"])


@dataclass
class _Whole:
    """What is known of a column before its values are looked at in order, and of the ranges they lie in: by the first value, how many values come before and which is the last of them."""

    n: int
    kinds: int
    mean: float
    low: float
    high: float
    bits: float
    ranges: dict[bytes, tuple[int, float | None]]
    ranks: list[int] = field(default_factory=list)
    step: bool = False

    @property
    def width(self) -> float:
        return (self.high - self.low) / P.BINS or 1.0


def _walk(whole: dict[int, _Whole], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """k, v, n, the values before each (NaN: none), and how many values come before the first, in pieces of one column."""
    known: dict[int, tuple[int, float | None]] = {}
    for ks, vs, ns in _pieces(batches):
        for k, at in _by_k(ks):
            if k not in whole:
                continue
            v, n = vs[at], ns[at]
            skipped, last = known[k] if k in known else whole[k].ranges[np.float64(v[0]).tobytes()]
            yield k, v, n, np.append(np.nan if last is None else last, v[:-1]), skipped
            known[k] = skipped + int(n.sum()), float(v[-1])


#: Sums over a column's values: powers of the distance to the mean, products of neighbours' distances, repeats, and what fails the flags.
SUMS = ("whole", "third", "fourth", "lagged", "level", "no_bit", "no_int_bool", "no_integer", "no_midnight")


def _looked_at(whole: dict[int, _Whole]):
    """For mapInArrow over values in order: k, what, i, v, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, str, int, float | None, int | None]] = []
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        gcds: dict[int, int] = {}
        with np.errstate(all="ignore"):
            for k, v, n, before, skipped in _walk(whole, batches):
                w = whole[k]
                upto = skipped + np.cumsum(n)
                for i, rank in enumerate(w.ranks):
                    if skipped <= rank < upto[-1]:
                        out.append((k, "rank", i, float(v[np.searchsorted(upto, rank, "right")]), None))
                bins = np.bincount(np.clip(np.nan_to_num(np.floor((v - w.low) / w.width)), 0, P.BINS - 1).astype(np.int64), n, P.BINS)
                d, e = v - w.mean, before - w.mean
                behind = slice(0 if skipped else 1, None)
                bit = (v > -0.5) & (v < 1.5)
                fract = v - np.clip(np.trunc(v), -(2.0**63), 2.0**63)
                fails = [~bit, ~((fract < 1e-9) & bit), ~(np.abs(fract) < 2.2e-16), ~(np.mod(v, 86_400_000_000.0) == 0)]
                found = [(n * d * d).sum(), (n * d**3).sum(), (n * d**4).sum(), ((n - 1) * d * d).sum() + (d[behind] * e[behind]).sum(), (n - 1).sum(), *(f.sum() for f in fails)]
                sums[k] = sums.get(k, 0.0) + np.array(found, np.float64)
                if w.step:
                    size = np.abs(v)
                    bands = [[(size / scale >= a) & (size / scale <= b) for a, b in P.BANDS] for scale in P.UNITS.values()]
                    more = [int(n[x].sum()) for unit in bands for x in unit] + [int((~np.logical_or.reduce(unit)).sum()) for unit in bands]
                    step = np.abs(v[behind] - before[behind])
                    step = np.unique(np.where(step >= 2.0**63, np.iinfo(np.int64).max, np.nan_to_num(step, posinf=0).astype(np.int64)))
                    gcds[k] = int(np.gcd.reduce(np.append(step, gcds.get(k, 0))))
                else:
                    more = []
                counts[k] = counts.get(k, 0) + np.append(bins.astype(np.int64), np.array(more, np.int64))
        out += [(k, name, 0, float(x), None) for k, those in sums.items() for name, x in zip(SUMS, those)]
        out += [(k, "count", i, None, int(x)) for k, those in counts.items() for i, x in enumerate(those)]
        out += [(k, "gcd", 0, None, g) for k, g in gcds.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int64()))], ["k", "what", "i", "v", "n"])

    return run


def _steps(whole: dict[int, _Whole]):
    """For mapInArrow over values in order: k, the differences of neighbours, and how often each is met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for k, v, _, before, skipped in _walk(whole, batches):
                delta, n = np.unique((v - before)[0 if skipped else 1 :], return_counts=True)
                if len(delta):
                    yield _batch(k, delta + 0.0, n)

    return run


# --- all columns of a table ---------------------------------------------------------------


def field_stats(df: DataFrame, votes: bool = False) -> dict[str, FieldStats]:
    """FieldStats of every column, by name. An empty table and columns of nulls have counts alone.

    votes: only what the rules of `promote` read: flags of all columns and lengths of texts, and everything of whole numbers alone.
    """
    kinds = dict(df.dtypes)
    if not kinds:
        return {}
    names = list(kinds)
    rows, wide = _wide(df, kinds, votes)
    out: dict[str, FieldStats] = {}
    for c, r in zip(names, wide):
        n = r["n"]
        s = FieldStats(source=kinds[c], sample_size=n, null_count=rows - n, is_null=rows > n, null_ratio=(rows - n) / n if n else 0.0)
        kind = next(f for f in df.schema.fields if f.name == c).dataType
        if isinstance(kind, DecimalType):
            s.numeric_precision, s.numeric_scale = kind.precision, kind.scale
        out[c] = s
    live = [k for k, c in enumerate(names) if not out[c].silent]
    by_group = {k: group_of(kinds[names[k]]) for k in live}
    for k in live:
        s, g = out[names[k]], by_group[k]
        s.signature, s.is_monotonic = SIGNATURES[g], monotonic(kinds[names[k]], rows)
        _simple(s, wide[k], g, rows)
    ordered = [k for k in live if by_group[k] in ("number", "stamp", "date", "text", "binary")]
    if votes:
        ordered = [k for k in ordered if kinds[names[k]] in ("int", "bigint")]
    _ordered(df, names, kinds, out, ordered, by_group, rows)
    if not votes:
        _distinct(df, names, out, [k for k in live if by_group[k] in ("text", "binary")], rows)
    return out


def _simple(s: FieldStats, r: dict, group: str, rows: int) -> None:
    s.cardinality = 1.0
    if group == "boolean":
        no = s.sample_size - r["yes"]
        s.distinct_count, s.min_val, s.max_val, s.all_int_bools = (r["yes"] > 0) + (no > 0), r["min"], r["max"], True
        s.entropy = _entropy([r["yes"], no], 2)
        s.cardinality = 2 / rows if rows >= 2 else 1.0
        return
    for name, x in r.items():
        if name != "n":
            setattr(s, name, x)
    if group == "text" and not s.all_floats:
        s.all_integers = None


def _moments(n: int, whole: float, third: float, fourth: float) -> tuple[float | None, float | None]:
    """Skewness and kurtosis, corrected for the sample size over population deviations."""
    if whole == 0:
        return 0.0, 0.0
    s2 = whole / n
    skewness = n / ((n - 1) * (n - 2)) * third / s2**1.5 if n > 2 else None
    kurtosis = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * fourth / (s2 * s2) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)) if n > 3 else None
    return skewness, kurtosis


def _known(heads: list[Row]) -> dict[int, _Whole]:
    """Of each column, from its ranges of values."""
    out: dict[int, _Whole] = {}
    by_k: dict[int, list[Row]] = {}
    for r in sorted(heads, key=lambda r: (r.k, math.isnan(r.low), r.low)):
        by_k.setdefault(r.k, []).append(r)
    for k, those in by_k.items():
        ranges, n, last = {}, 0, None
        for r in those:
            ranges[np.float64(r.low).tobytes()] = (n, last)
            n, last = n + r.held, r.top
        kinds, totals = sum(r.kinds for r in those), [r.total for r in those]
        mean = those[0].low if kinds == 1 else (math.fsum(totals) if all(map(math.isfinite, totals)) else sum(totals)) / n
        out[k] = _Whole(n, kinds, mean, those[0].low, last, math.fsum(r.bits for r in those), ranges)
    return out


def _ordered(df: DataFrame, names: list[str], kinds: dict[str, str], out: dict[str, FieldStats], those: list[int], group: dict[int, str], rows: int) -> None:
    """Moments, flags, bands, quantiles, percentiles, histogram, autocorrelation, entropy and divisor of differences, and characters.

    Tasks count what they meet; the counts are put in order in ranges, each of which is walked through in pieces.
    """
    if not those:
        return
    value = {"text": lambda c, kind: c, "binary": lambda c, kind: c, "stamp": lambda c, kind: c.cast("timestamp_ntz")}
    chosen = df.select(*(value.get(group[k], lambda c, kind: P.value_of(kind, c))(F.col(f"`{names[k]}`"), kinds[names[k]]).alias(f"x{k}") for k in those))
    counted = chosen.mapInArrow(_counter([(k, group[k]) for k in those]), "k int, v double, n long").persist(StorageLevel.DISK_ONLY)
    frames = [counted]
    try:
        ranges = max(1, -(-counted.count() // RANGE_VALUES))
        s = counted.repartitionByRange(ranges, "k", "v").sortWithinPartitions("k", "v").mapInArrow(_in_order, "k int, v double, n long").persist(StorageLevel.DISK_ONLY)
        frames.append(s)
        every = _known(s.mapInArrow(_heads, "k int, low double, top double, kinds long, held long, total double, bits double").collect())
        counted.unpersist()
        whole = {k: every[k] for k in those}
        for k, w in whole.items():
            floor = [math.floor(i * (w.n - 1) / 12) for i in range(1, 12)]
            w.ranks = [*floor, *(min(f + 1, w.n - 1) for f in floor), *(min(math.floor(w.n * p), w.n - 1) for p in (0.1, 0.9))]
            w.step = group[k] in ("number", "stamp")
        found: dict[int, dict[tuple[str, int], list]] = {k: {} for k in those}
        for r in s.mapInArrow(_looked_at(whole), "k int, what string, i int, v double, n long").collect():
            found[r.k].setdefault((r.what, r.i), []).append(r.v if r.n is None else r.n)
        numbers = {k: w for k, w in whole.items() if w.step}
        steps = {}
        if numbers:
            apart = s.where(F.col("k").isin(list(numbers))).mapInArrow(_steps(numbers), "k int, delta double, n long").groupBy("k", "delta").agg(F.sum("n").alias("n"))
            steps = {r.k: r for r in apart.groupBy("k").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("bits")).collect()}
        classes = _classes(s.where(F.col("k") >= LETTERS)) if any(group[k] in ("text", "binary") for k in those) else {}
    finally:
        for f in frames:
            f.unpersist()
    for k in those:
        f, w, r = out[names[k]], whole[k], found[k]
        total = lambda name: math.fsum(r.get((name, 0), [])) if all(map(math.isfinite, r.get((name, 0), []))) else math.nan  # noqa: B023, E731
        rank = [r[("rank", i)][0] for i in range(24)]
        if w.n > LEAST_FOR_QUANTILES:
            part = lambda i: i * (w.n - 1) / 12 - math.floor(i * (w.n - 1) / 12)  # noqa: B023, E731
            quantiles = [rank[i - 1] * (1 - part(i)) + rank[i + 10] * part(i) for i in range(1, 12)]
        else:
            quantiles = None
        f.distinct_count = w.kinds
        if group[k] in ("text", "binary"):
            f.avg, f.char_min_length, f.char_max_length = w.mean, int(w.low), int(w.high)
            f.char_classes = classes.get(k, [0.0] * 5)
            if group[k] == "binary":
                f.entropy = (math.log2(w.n) - w.bits / w.n) / math.log2(w.kinds) if w.kinds > 1 else 0.0
            else:
                f.quantiles, letters = quantiles, every.get(k + LETTERS)
                f.entropy = 0.0 if letters is None else float("nan") if letters.kinds == 1 else (math.log2(letters.n) - letters.bits / letters.n) / math.log2(letters.kinds)
            continue
        f.quantiles, f.p10, f.p90 = quantiles, rank[22], rank[23]
        f.min_val, f.max_val = (int(w.low), int(w.high)) if group[k] == "date" else (w.low, w.high)
        counts = [sum(r[("count", i)]) for i in range(P.BINS + (len(P.UNITS) * (len(P.BANDS) + 1) if w.step else 0))]
        f.histogram_entropy = _entropy(counts[: P.BINS], math.e) if w.low < w.high else 0.0
        if group[k] == "number" and kinds[names[k]] in ("tinyint", "smallint", "int", "bigint") or group[k] == "date":
            f.cardinality = w.kinds / rows if rows >= 2 else 1.0
        if group[k] == "date":
            continue
        f.avg = w.mean
        f.skewness, f.kurtosis = _moments(w.n, total("whole"), total("third"), total("fourth"))
        f.all_int_bools, f.all_integers = total("no_int_bool") == 0, total("no_integer") == 0 and total("no_bit") > 0
        if group[k] == "stamp":
            f.all_timestamp_date32 = total("no_midnight") == 0
        bands, outside = counts[P.BINS : -len(P.UNITS)], counts[-len(P.UNITS) :]
        f.timestamp_bands = {u: bands[i * len(P.BANDS) : (i + 1) * len(P.BANDS)] for i, u in enumerate(P.UNITS) if not outside[i]}
        f.autocorrelation = total("lagged") / total("whole") if total("whole") else None
        f.delta_gcd = math.gcd(*r.get(("gcd", 0), [0])) or None
        # equal neighbours differ by 0: one more kind of difference, if there are any
        step, level = steps.get(k), round(total("level"))
        kinds_of_step = (step.kinds if step else 0) + (level > 0)
        if kinds_of_step > 1:
            all_steps, bits = (step.total if step else 0) + level, (step.bits if step else 0.0) + (level * math.log2(level) if level else 0.0)
            f.entropy = (math.log2(all_steps) - bits / all_steps) / math.log2(kinds_of_step) * w.kinds / w.n


def _classes(letters: DataFrame) -> dict[int, list[float]]:
    """Shares of the character classes of each column's characters, which are as few as there are code points. letters: k + LETTERS, v (a code point) and n."""
    found = letters.collect()
    if not found:
        return {}
    codes = sorted({int(r.v) for r in found})
    own = letters.sparkSession.createDataFrame([(c, chr(c)) for c in codes], "code int, ch string").select("code", *(F.expr(sql).alias(f"c{i}") for i, sql in enumerate(X.class_sql("ch")))).collect()
    of = {r[0]: r[1:] for r in own}
    sums: dict[int, list[int]] = {}
    for r in found:
        those = sums.setdefault(r.k - LETTERS, [0] * 5)
        for i, x in enumerate(of[int(r.v)]):
            those[i] += x * r.n
    return {k: [x / sum(those) for x in those] for k, those in sums.items()}


def _distinct(df: DataFrame, names: list[str], out: dict[str, FieldStats], those: list[int], rows: int) -> None:
    """Cardinality of texts and binaries. Those of 32 bytes or more are told apart by their digests, which have as many."""
    if not those:
        return
    exact = lambda b: F.when(F.octet_length(b) < 32, b).otherwise(F.unhex(F.sha2(b, 256)))
    whole = _long(df, [(k, exact(F.col(f"`{names[k]}`").cast("binary"))) for k in those], "b").groupBy("k", "b").agg(F.lit(1).alias("one"))
    kinds = {r.k: r.kinds for r in whole.groupBy("k").agg(F.count("*").alias("kinds")).collect()}
    for k in those:
        out[names[k]].cardinality = kinds.get(k, 0) / rows if rows >= 2 else 1.0
        if out[names[k]].source != "string":
            out[names[k]].distinct_count = kinds.get(k, 0)


SCHEMA = (
    "column_name string, source string, sample_size long, null_count long, is_null boolean, null_ratio double, cardinality double, distinct_count long, avg double, median double, min_val double, max_val double, char_min_length int, char_max_length int, numeric_precision int, "
    "numeric_scale int, datetime_precision int, quantiles array<double>, p10 double, p90 double, delta_gcd long, entropy double, kurtosis double, skewness double, histogram_entropy double, autocorrelation double, is_monotonic boolean, all_int_bools boolean, all_integers boolean, "
    "all_floats boolean, all_array boolean, all_json boolean, all_time boolean, all_date32 boolean, all_timestamp boolean, all_uuid boolean, all_utf8_bools boolean, timestamp_bands map<string, array<long>>, all_timestamp_date32 boolean, signature string, char_classes array<double>"
)


def stats_frame(df: DataFrame) -> DataFrame:
    """field_stats as a frame: one row a column."""
    whole = {"sample_size", "null_count", "distinct_count", "char_min_length", "char_max_length", "numeric_precision", "numeric_scale", "datetime_precision", "delta_gcd"}
    rows = []
    for name, s in field_stats(df).items():
        values = asdict(s)
        rows.append((name, *(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and k not in whole else v for k, v in values.items())))
    return df.sparkSession.createDataFrame(rows, SCHEMA)
