"""Column profiles as aggregates.

Statistics of one column, each by itself; `fieldstats` computes all statistics of all columns together. Those of sorted
values are computed from the counts of distinct values, cut into ranges (`fieldstats.ranked`), so that no window runs over the whole column in one task.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

BINS = 6
#: Upper ends of the magnitude bands of possible epoch values, and what a unit's second is.
BANDS = [(0.0, 99_999.0), (1e5, 999_999.0), (1e6, 9_999_999.0), (1e7, 99_999_999.0), (1e8, 999_999_999.0), (1e9, 9_999_936_000.0)]
UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def count_columns(kind: str, column: str) -> list[Column]:
    c = F.col(column)
    n, rows = F.count(c), F.count(F.lit(1))
    if kind == "boolean":
        ratio = F.lit(2.0) / rows
    elif kind in ("float", "double") or kind.startswith(("decimal", "timestamp", "array", "map", "struct")):
        ratio = F.lit(1.0)
    else:
        ratio = F.count_distinct(c) / rows
    return [n.alias("sample_size"), (rows - n).alias("null_count"), (rows > n).alias("is_null"), F.coalesce(F.try_divide(rows - n, n), F.lit(0.0)).alias("null_ratio"), F.when(rows < 2, F.lit(1.0)).otherwise(ratio).alias("cardinality")]


def counts(df: DataFrame, column: str) -> DataFrame:
    """sample_size, null_count, is_null, null_ratio (of nulls to values) and cardinality (distinct values to rows) of a column."""
    return df.agg(*count_columns(dict(df.dtypes)[column], column))


def value_of(kind: str, c: Column) -> Column:
    """A number, date or time as a double: days for dates, microseconds of local time for timestamps."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        second = F.extract(F.lit("SECOND"), c).cast("decimal(8,6)")
        return (F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (second * 1_000_000).cast("long")).cast("double")
    return c.cast("double")


def value(df: DataFrame, column: str) -> Column:
    return value_of(dict(df.dtypes)[column], F.col(column))


def moment_sql(x: str) -> dict[str, str]:
    """avg, min, max, and skewness and kurtosis corrected for the sample size over population deviations."""
    n = f"cast(count({x}) AS double)"
    return {
        "avg": f"avg({x})",
        "min": f"min({x})",
        "max": f"max({x})",
        "skewness": f"if(var_pop({x}) = 0, 0D, try_divide(skewness({x}) * {n} * {n}, ({n} - 1) * ({n} - 2)))",
        "kurtosis": f"if(var_pop({x}) = 0, 0D, try_divide({n} * {n} * ({n} + 1) * (kurtosis({x}) + 3), ({n} - 1) * ({n} - 2) * ({n} - 3)) - try_divide(3 * ({n} - 1) * ({n} - 1), ({n} - 2) * ({n} - 3)))",
    }


def _aggregated(df: DataFrame, v: Column, wanted: dict[str, str]) -> DataFrame:
    """These aggregates, as SQL over x, of a column."""
    return df.select(v.alias("x")).agg(*(F.expr(sql).alias(name) for name, sql in wanted.items()))


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, distinct_count and the moments of a column."""
    return _aggregated(df, value(df, column), {"n": "count(x)", "distinct_count": "count(DISTINCT x)"} | moment_sql("x"))


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """v, n (how often), before (the next smaller value) and upto (values up to and with this one) of a column's distinct values.

    The ranges are cut at quantiles of the distinct values, however often each occurs, and there are more of them the more distinct values there are.
    """
    from .fieldstats import ranked

    v = value(df, column)
    counted = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("n")).select(F.lit(0).alias("k"), "v", "n")
    return ranked(counted, {0: counted.count()}).drop("k")


def rank_value(k: Column) -> Column:
    """Of sorted_values: the value of rank k from 0."""
    return F.min(F.when(F.col("upto") > k, F.col("v")))


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """q1 to q11 at ranks i(n-1)/12, interpolated; only for more than 20 values."""
    n = df.agg(F.count(column)).first()[0]
    if n <= 20:
        return df.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(f"q{i}") for i in range(1, 12)))
    out = []
    for i in range(1, 12):
        rank = i * (n - 1) / 12
        low, part = math.floor(rank), rank - math.floor(rank)
        out.append((rank_value(F.lit(low)) * (1 - part) + rank_value(F.lit(min(low + 1, n - 1))) * part).alias(f"q{i}"))
    return sorted_values(df, column).agg(*out)


def percentiles(df: DataFrame, column: str, ps: tuple[float, ...] = (0.1, 0.9)) -> DataFrame:
    """p10, p90...: the value of rank floor(n p), at most n - 1."""
    n = df.agg(F.count(column)).first()[0]
    return sorted_values(df, column).agg(*(rank_value(F.lit(min(math.floor(n * p), n - 1))).alias(f"p{round(p * 100)}") for p in ps))


def deltas(df: DataFrame, column: str) -> DataFrame:
    """delta and n: differences of neighbours in order, and how often; equal neighbours differ by 0."""
    s = sorted_values(df, column)
    apart = s.where("before IS NOT NULL").groupBy((F.col("v") - F.col("before")).alias("delta")).agg(F.count("*").alias("n"))
    return apart.unionAll(s.agg(F.sum(F.col("n") - 1).alias("n")).where("n > 0").select(F.lit(0.0).alias("delta"), "n")).groupBy("delta").agg(F.sum("n").alias("n"))


def shannon(counted: DataFrame, base: float = 2.0) -> DataFrame:
    """total, kinds and entropy of a frame with counts n."""
    total = F.sum("n").cast("double")
    bits = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return counted.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), (bits / math.log2(base) if base != 2.0 else bits).alias("entropy"))


def delta_entropy(df: DataFrame, column: str) -> DataFrame:
    """Entropy of the differences of neighbours, over that of as many equally frequent ones, times the share of distinct values."""
    share = df.agg(F.try_divide(F.count_distinct(value(df, column)), F.count(column)).alias("share"))
    h = shannon(deltas(df, column))
    return h.crossJoin(F.broadcast(share)).select(F.when(F.col("kinds") <= 1, 0.0).otherwise(F.col("entropy") / F.log2("kinds") * F.col("share")).alias("entropy"))


def histogram_entropy(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Natural entropy of equal bins over the range of the values; 0 for a single value."""
    v = value(df, column)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None or low == high:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("histogram_entropy"))
    number = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return shannon(df.where(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n")), math.e).select(F.col("entropy").alias("histogram_entropy"))


def autocorrelation(df: DataFrame, column: str) -> DataFrame:
    """Lag-1 autocorrelation of the values in order; null without variance."""
    mean = df.agg(F.avg(value(df, column))).first()[0]
    d, e = F.col("v") - F.lit(mean), F.col("before") - F.lit(mean)
    whole = F.sum(F.col("n") * d * d)
    return sorted_values(df, column).agg(F.when(whole != 0, (F.sum((F.col("n") - 1) * d * d) + F.coalesce(F.sum(d * e), F.lit(0.0))) / whole).alias("autocorrelation"))


def _gcd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g = 0
    for b in batches:
        g = int(np.gcd.reduce(np.append(b.column(0).to_numpy(zero_copy_only=False), g)))
    yield pa.RecordBatch.from_arrays([pa.array([g])], ["g"])


def delta_gcd(df: DataFrame, column: str) -> DataFrame:
    """Greatest common divisor of the differences that aren't 0, truncated; null if there is none."""
    whole = deltas(df, column).where("delta <> 0").select(F.abs("delta").cast("long").alias("g")).distinct()
    return whole.mapInArrow(_gcd, "g long").where("g > 0").repartition(1).mapInArrow(_gcd, "g long").select(F.nullif("g", F.lit(0)).alias("delta_gcd"))


def band_sql(x: str) -> dict[str, str]:
    """Of each unit: six counts of magnitudes, and whether each value lies in a band."""
    out = {}
    for unit, scale in UNITS.items():
        within = [f"abs({x}) / {scale}D BETWEEN {a}D AND {b}D" for a, b in BANDS]
        out |= {f"{unit}{i}": f"count_if({w})" for i, w in enumerate(within)}
        out[f"{unit}_inside"] = f"coalesce(bool_and({' OR '.join(within)}), false)"
    return out


def timestamp_bands(df: DataFrame, column: str) -> DataFrame:
    """unit and six counts: how many magnitudes in that unit lie in each band; a unit with a value outside of all is left out. One pass for all units."""
    found = _aggregated(df, value(df, column), band_sql("x"))
    rows = [f"named_struct('unit', '{u}', {', '.join(f"'band{i}', {u}{i}" for i in range(len(BANDS)))}, 'inside', {u}_inside)" for u in UNITS]
    return found.select(F.explode(F.expr(f"array({', '.join(rows)})")).alias("s")).select("s.*").where("inside").drop("inside")


def number_flag_sql(x: str) -> dict[str, str]:
    """all_int_bools: every value rounds to 0 or 1; all_integers: every value is whole, and not all are 0 or 1."""
    fract, bit = f"({x} - if({x} < 0, ceil({x}), floor({x})))", f"round({x}) IN (0D, 1D)"
    return {"all_int_bools": f"coalesce(bool_and({fract} < 1e-9D AND {bit}), false)", "all_integers": f"coalesce(bool_and(abs({fract}) < 2.2e-16D), false) AND NOT coalesce(bool_and({bit}), false)"}


def number_flags(df: DataFrame, column: str) -> DataFrame:
    return _aggregated(df, value(df, column), number_flag_sql("x"))


def text_sql(x: str) -> dict[str, str]:
    """Byte lengths, and what all of the texts look like."""
    every = lambda sql: f"coalesce(bool_and({sql}), false)"
    number = X.number_sql(x)
    fract = f"({number} - if({number} < 0, ceil({number}), floor({number})))"
    numeric = every(f"{number} IS NOT NULL OR {x} IS NULL")
    return {
        "avg": f"avg(octet_length({x}))",
        "char_min_length": f"min(octet_length({x}))",
        "char_max_length": f"max(octet_length({x}))",
        "all_array": every(f"trim({x}) LIKE '[%]'"),
        "all_json": every(f"trim({x}) LIKE '{{%}}'"),
        "all_floats": numeric,
        "all_integers": f"({numeric} AND {every(f'abs({fract}) < 2.2e-16D')} AND NOT {every(f'round({number}) IN (0D, 1D)')})",
        "all_uuid": every(X.uuid_sql(x)),
        "all_utf8_bools": every(f"{x} IN ({', '.join(map(repr, X.BOOLEAN_WORDS))})"),
        "all_date32": every(f"{X.formats.as_date(x)} IS NOT NULL OR {x} IS NULL"),
        "all_timestamp": every(f"{X.formats.as_timestamp(x)} IS NOT NULL OR {x} IS NULL"),
        "all_time": every(f"{X.formats.as_time(x)} IS NOT NULL OR {x} IS NULL"),
    }


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """Byte lengths, the number of distinct lengths, and what all of the texts look like."""
    return _aggregated(df, F.col(column), {"sample_size": "count(x)", "distinct_count": "count(DISTINCT octet_length(x))"} | text_sql("x"))


def char_classes(df: DataFrame, column: str) -> DataFrame:
    """Shares of digits, letters, blanks, marks and others among all characters; zeros without characters."""
    names = ("digit", "alpha", "blank", "mark", "other")
    return _aggregated(df, F.col(column), {name: f"if(sum(char_length(x)) > 0, sum({k}) / sum(char_length(x)), 0D)" for name, k in zip(names, X.class_sql("x"))})


def char_entropy(df: DataFrame, column: str) -> DataFrame:
    """Entropy of the characters of all texts over that of as many equally frequent ones; NaN for one distinct character, 0 for none."""
    each = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.explode(F.split(F.col(column), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return shannon(each).select(F.when(F.col("kinds") == 0, 0.0).when(F.col("kinds") == 1, float("nan")).otherwise(F.col("entropy") / F.log2("kinds")).alias("entropy"))


def boolean_profile(df: DataFrame, column: str) -> DataFrame:
    """distinct_count, min and max as 0 or 1, and the entropy in bits."""
    v = F.col(column).cast("boolean").cast("int")
    h = shannon(df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("n"))).select(F.coalesce("entropy", F.lit(0.0)).alias("entropy"))
    return df.agg(F.count_distinct(v).alias("distinct_count"), F.min(v).alias("min"), F.max(v).alias("max")).crossJoin(F.broadcast(h))


def binary_profile(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, lengths, and the entropy of lengths over that of as many equally frequent ones."""
    c = F.col(column).cast("binary")
    h = shannon(df.where(c.isNotNull()).groupBy(F.octet_length(c).alias("l")).agg(F.count("*").alias("n"))).select(F.when(F.col("kinds") <= 1, 0.0).otherwise(F.col("entropy") / F.log2("kinds")).alias("entropy"))
    return df.agg(F.count_distinct(c).alias("distinct_count"), F.min(F.octet_length(c)).alias("min"), F.max(F.octet_length(c)).alias("max"), F.avg(F.octet_length(c)).alias("avg")).crossJoin(F.broadcast(h))


def date_alignment(df: DataFrame, column: str) -> DataFrame:
    """all_timestamp_date32: every value is a midnight."""
    return df.agg(midnight_of(dict(df.dtypes)[column], F.col(column)))


def midnight_of(kind: str, c: Column) -> Column:
    return X.all_true(c == c.cast("date").cast(kind)).alias("all_timestamp_date32")
