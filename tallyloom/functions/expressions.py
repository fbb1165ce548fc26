"""Column expressions: vectors, sets, text shapes and temporal formats. All are built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats

#: Beginnings of these words, from the given length on, and numbers stand for truth values; letters are lower case and nothing is trimmed.
TRUE_WORDS = [w[:k] for w, least in (("true", 1), ("yes", 1), ("on", 2)) for k in range(least, len(w) + 1)] + ["1", "1.0"]
FALSE_WORDS = [w[:k] for w, least in (("false", 1), ("no", 1), ("off", 2)) for k in range(least, len(w) + 1)] + ["0", "0.0"]
BOOLEAN_WORDS = TRUE_WORDS + FALSE_WORDS
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
UUID = "^[0-9a-fA-F]{32}$"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; the product of the norms counts as 1e-6 at least."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-6))


def normalised(a: Column) -> Column:
    """A vector of length one; a vector shorter than 1e-8 stays."""
    return F.when(norm(a) < 1e-8, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def similarity_vector(pairs: Column, n: Column | int) -> Column:
    """Array of length n from structs (i, sim): the largest of an index, 0 where there is none."""
    size = n if isinstance(n, Column) else F.lit(n)
    at = lambda i: F.array_max(F.transform(F.filter(pairs, lambda p: p["i"] == i), lambda p: p["sim"]))
    return F.when(size <= 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(at(i), F.lit(0.0))))


def _digits_sql(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, 'urn:uuid:'), '[-{{}}]', ''))"


def uuid_sql(x: str) -> str:
    return f"{_digits_sql(x)} RLIKE '{UUID}'"


def to_uuid(c: Column) -> Column:
    """The 16 bytes of a UUID text, null if it isn't one."""
    return formats.bound(c, f"if({uuid_sql('x')}, unhex({_digits_sql('x')}), NULL)")


def number_sql(x: str) -> str:
    return f"nullif(nullif(if({x} RLIKE r'{FLOAT}', cast({x} AS double), NULL), double('Infinity')), double('-Infinity'))"


def to_number(c: Column) -> Column:
    """A finite double, without the blanks and suffixes that a plain cast accepts."""
    return formats.bound(c, number_sql("x"))


to_date, to_timestamp, to_time = formats.to_date, formats.to_timestamp, formats.to_time


def replace_float_bool(c: Column) -> Column:
    """1.0 and 0.0 as 1 and 0; other texts as they are."""
    return F.regexp_replace(F.regexp_replace(c, r"^1\.0$", "1"), r"^0\.0$", "0")


def class_sql(x: str) -> list[str]:
    """Characters of a text that are digits, letters, ASCII blanks, ASCII marks, and others."""
    own = [f"regexp_count({x}, r'{k}')" for k in ("[0-9]", r"\p{IsAlphabetic}", r"[ \t\n\f\r]", r"[!-/:-@\[-`{-~]")]
    return [*own, f"(char_length({x}) - {' - '.join(own)})"]


def all_true(c: Column) -> Column:
    return F.coalesce(F.bool_and(c), F.lit(False))


def hex_id(*parts: Column) -> Column:
    """A reproducible id of names."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
