"""Type promotion: rules vote on the types that a column could be cast to.

A candidate wins if it has votes for it, and the cast's safety times its net vote reaches 0.65.
Rules read one row of statistics a column, so they run on the driver whatever the data's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import profile as P
from .fieldstats import FieldStats, field_stats

UUID, DATE, TIME, STAMP, LIST = "FixedSizeBinary(16)", "Date32", "Time32(ms)", "Timestamp(us)", "List(Utf8)"
SAFE, LOSSY, UNSAFE, BAR = 0.98, 0.86, 0.48, 0.65
EPOCHS = {f"Timestamp({u})": u for u in P.UNITS}
CANDIDATES = {"string": [UUID, DATE, TIME, STAMP, LIST, "Int64", "Float64", "Boolean"], "long": [*EPOCHS, "Boolean"], "timestamp": [DATE], "number": ["Boolean", "Int64"]}
#: Logical types of Spark's own.
LOGICAL = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "boolean": "Boolean", "string": "Utf8", "binary": "Binary", "date": DATE, "void": "Null"}
#: A unit's second times this is what its span is held against.
EXPECTED = {"s": 1.0, "ms": 1e6, "us": 1e9, "ns": 1e12}
YEARS = 200 * 365.25 * 86400
#: Seconds of the years 1900 and 2100.
EPOCH_RANGE = (-2_208_988_800, 4_102_444_800)


@dataclass
class Promotion:
    column: str
    source: str
    target: str
    confidence: float
    votes: dict[str, tuple[int, int]] = field(default_factory=dict)


def kind_of(spark_type: str) -> str | None:
    if spark_type == "string":
        return "string"
    if spark_type in ("int", "bigint"):
        return "long"
    if spark_type.startswith("timestamp"):
        return "timestamp"
    return "number" if spark_type in ("tinyint", "smallint", "float", "double") else None


def logical(spark_type: str) -> str:
    if spark_type.startswith("timestamp"):
        return STAMP
    if spark_type.startswith("decimal"):
        return "Decimal128(" + spark_type[8:-1].replace(",", ", ") + ")"
    return LOGICAL.get(spark_type, spark_type)


def _family(t: str) -> str:
    return t.split("(")[0]


def cast_safety(a: str, b: str) -> float:
    """How far a cast of logical type a to b can be trusted: it can't fail, it may fail or lose something, or it shouldn't be made."""
    whole = ["Int8", "Int16", "Int32", "Int64"]
    if a == b:
        return SAFE
    x, y = _family(a), _family(b)
    if a in whole and b in whole:
        if whole.index(a) < whole.index(b):
            return SAFE
        return LOSSY if a == "Int64" else UNSAFE
    if x == "Decimal32" and y in ("Decimal64", "Decimal128", "Decimal256"):
        return SAFE
    if (x == "Timestamp" and b == "Int64") or (a, b) in ((DATE, "Int32"), ("Utf8", "Binary"), (UUID, "Utf8")):
        return SAFE
    if x == "Timestamp" and y == "Timestamp":
        return LOSSY  # other units; equal ones were equal types
    lossy = {
        "Int64": ("Timestamp",),
        "Timestamp": (DATE,),
        "Int32": (DATE,),
        "Float64": ("Int64",),
        "Utf8": ("List", "Struct", "Timestamp", UUID, DATE, "Float64", "Int64", "Boolean"),
        "Binary": (UUID,),
    }
    if y in lossy.get(x, ()) or b in lossy.get(x, ()):
        return LOSSY
    return LOSSY if b == "Boolean" and a in (*whole, "Float16", "Float32", "Float64") else UNSAFE


def meta_for(target: str, stats: FieldStats, char_max_length: int | None = None) -> dict[str, int | None]:
    """Precisions and lengths of a promoted column: times have six digits; dates, truth values and numbers none; others keep theirs."""
    if target == DATE or target == "Boolean" or target.startswith(("Time32", "Int", "UInt", "Float", "Decimal")):
        return {"datetime_precision": None, "numeric_precision": None, "numeric_scale": None, "char_max_length": None}
    if target.startswith("Timestamp"):
        return {"datetime_precision": 6, "numeric_precision": None, "numeric_scale": None, "char_max_length": None}
    return {"datetime_precision": stats.datetime_precision, "numeric_precision": stats.numeric_precision, "numeric_scale": stats.numeric_scale, "char_max_length": stats.char_max_length if char_max_length is None else char_max_length}


class Tally:
    """Votes of the rules on one candidate; a rule that says None abstains."""

    def __init__(self, *votes: bool | None):
        self.up = self.down = 0
        for v in votes:
            self.cast(v)

    def cast(self, vote: bool | None) -> None:
        if vote is not None:
            self.up, self.down = self.up + vote, self.down + (not vote)

    @property
    def net(self) -> float:
        return (self.up - self.down) / (self.up + self.down) if self.up + self.down else 0.0

    @property
    def majority(self) -> bool:
        return self.up > self.down


# --- rules: whether they are for a candidate, against it, or (None) say nothing ----------


def uuid_rule(s: FieldStats, target: str) -> bool | None:
    return target == UUID if s.all_uuid and 32 <= s.char_max_length <= 45 else None


def datetime_rule(s: FieldStats, target: str) -> bool | None:
    return {DATE: s.all_date32, TIME: s.all_time, STAMP: s.all_timestamp}.get(target)


def json_rule(s: FieldStats, target: str) -> bool | None:
    return False if s.all_json and target in ("Int64", "Float64", "Boolean", DATE, UUID) else None


def array_rule(s: FieldStats, target: str) -> bool | None:
    if not s.all_array:
        return None
    return True if target == LIST else False if target in ("Int64", "Float64", "Boolean", DATE, UUID) else None


def float_rule(s: FieldStats, target: str) -> bool | None:
    if not s.all_floats or target not in ("Int64", "Float64"):
        return None
    return bool(s.all_integers) == (target == "Int64")


def boolean_rule(s: FieldStats, target: str) -> bool | None:
    return bool(s.all_utf8_bools) if target == "Boolean" else None


def numeric_rule(s: FieldStats, target: str) -> bool | None:
    if target == "Float64":
        return not (s.all_int_bools or s.all_integers)
    return {"Boolean": s.all_int_bools, "Int64": s.all_integers}.get(target)


def span_rule(s: FieldStats, unit: str) -> bool | None:
    if s.min_val is None or not s.min_val < s.max_val:
        return None
    span = max(s.max_val - s.min_val, 1.0) / EXPECTED[unit]
    if span < 1e-3 or span > 1e3 * YEARS:
        return False
    return True if 1 <= span <= YEARS else None


def quantile_rule(s: FieldStats, unit: str) -> bool | None:
    gaps = [b - a for a, b in zip(s.quantiles, s.quantiles[1:]) if b > a] if s.quantiles else []
    if not gaps:
        return None
    mean = sum(gaps) / len(gaps)
    spread = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / max(mean, 1.0)
    return 0.12 < spread < 0.9


def entropy_rule(s: FieldStats, unit: str) -> bool | None:
    return s.entropy > 0.90


def bands_rule(s: FieldStats, unit: str) -> bool | None:
    bands = s.timestamp_bands.get(unit)
    if s.sample_size <= 1 or not bands:
        return None
    used = [i for i, k in enumerate(bands) if k]
    if used and used[-1] - used[0] + 1 != len(used):
        return False
    return True if sum(bands) and sum(sorted(bands, reverse=True)[:2]) >= 0.5 * sum(bands) else None


def epoch_rule(s: FieldStats, unit: str) -> bool | None:
    if s.min_val is None or not s.min_val < s.max_val or s.p10 is None:
        return None
    scale = int(P.UNITS[unit])
    low, high = math.floor(s.p10 / scale), math.floor(s.p90 / scale)
    if low < EPOCH_RANGE[0] or high > EPOCH_RANGE[1]:
        return False
    if high - low < 60:
        return None
    return s.delta_gcd is None or s.delta_gcd <= scale


def date_rule(s: FieldStats, target: str) -> bool | None:
    return s.all_timestamp_date32


TEXT_RULES = (uuid_rule, datetime_rule, json_rule, array_rule, float_rule, boolean_rule)
EPOCH_RULES = (span_rule, quantile_rule, entropy_rule, bands_rule, epoch_rule)


def tallies(spark_type: str, s: FieldStats) -> dict[str, Tally]:
    """The votes on each candidate of a column's type, in their order."""
    kind = kind_of(spark_type)
    out = {}
    for t in CANDIDATES.get(kind, []):
        if kind == "string":
            votes = [r(s, t) for r in TEXT_RULES]
        elif kind == "timestamp":
            votes = [date_rule(s, t)]
        elif t in EPOCHS:
            votes = [r(s, EPOCHS[t]) for r in EPOCH_RULES] if s.all_integers else []
        else:
            votes = [numeric_rule(s, t)]
        out[t] = Tally(*votes)
    return out


def scout(source: str, votes: dict[str, Tally]) -> tuple[str, float]:
    """The best candidate by net vote, the earliest of equals, whose confidence is enough; else the type as it is, for sure."""
    for t, v in sorted(votes.items(), key=lambda x: -x[1].net):
        sure = cast_safety(source, t) * v.net
        if v.majority and sure >= BAR:
            return t, round(sure, 4)
    return source, 1.0


def decide(column: str, spark_type: str, s: FieldStats) -> Promotion:
    source = "Int64" if spark_type in ("int", "bigint") else logical(spark_type)  # ints are widened
    votes = {} if s.silent else tallies(spark_type, s)
    target, sure = scout(source, votes)
    return Promotion(column, spark_type, target, sure, {t: (v.up, v.down) for t, v in votes.items()})


def promote(df: DataFrame, columns: list[str] | None = None, stats: dict[str, FieldStats] | None = None) -> list[Promotion]:
    """What each column of these (all) should become. stats: of the columns, if they are known already."""
    chosen = [(c, t) for c, t in df.dtypes if (columns is None or c in columns) and kind_of(t)]
    if not chosen:
        return []
    stats = stats or field_stats(df.select(*(F.col(f"`{c}`") for c, _ in chosen)), votes=True)
    return [decide(c, t, stats[c]) for c, t in chosen]


def cast_column(c: Column, kind: str, target: str) -> Column:
    """The promoted column; what can't be cast is null."""
    if target == UUID:
        return X.to_uuid(c)
    if target == DATE:
        return X.to_date(c) if kind == "string" else c.cast("date")
    if target in EPOCHS or target == STAMP:
        if kind == "string":
            return X.to_timestamp(c)
        micros = (c.cast("decimal(38,6)") * F.lit(int(1e6)) / F.lit(int(P.UNITS[EPOCHS[target]]))).cast("long")
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400_000_000)).cast("int"))
        return day.cast("timestamp_ntz") + F.make_dt_interval(secs=(F.pmod(micros, F.lit(86_400_000_000)) / 1e6).cast("decimal(18,6)"))
    if target == TIME:
        return X.to_time(c)
    if target == LIST:
        return F.from_json(c, "array<string>")
    if target == "Boolean":
        return F.when(c.isin(X.TRUE_WORDS), True).when(c.isin(X.FALSE_WORDS), False) if kind == "string" else c.cast("double") != 0
    return X.to_number(c).cast("long" if target == "Int64" else "double") if kind == "string" else c.cast("long" if target == "Int64" else "double")


def apply(df: DataFrame, promotions: list[Promotion]) -> DataFrame:
    plan = {p.column: p for p in promotions if p.target != ("Int64" if p.source in ("int", "bigint") else logical(p.source))}
    return df.select(*(cast_column(F.col(f"`{c}`"), kind_of(t), plan[c].target).alias(c) if c in plan else F.col(f"`{c}`") for c, t in df.dtypes))
