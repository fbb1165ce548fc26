"""Texts as dates, times of day and timestamps, by closed lists of shapes.

A shape is written with one-letter fields in braces. A field takes as many digits as it may
and gives none back (possessive), so a text is read one way only; afterwards all fields must make a real
calendar day (of that weekday, if one is named) and a real time. Offsets are read and dropped.
"""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
#: Y year, y its last two digits, m d, b month name, w weekday name, H hour, I of twelve with p, M, S, f fraction, z offset.
FIELDS = {"Y": r"(\d{1,4}+)", "b": f"((?i:{'|'.join(MONTHS)}))", "w": f"((?i:{'|'.join(WEEKDAYS)}))", "p": "((?i:[ap]m))", "f": r"(?:\.(\d++))?+", "z": r"([+-]\d{2}[: ]?\d{2})"} | {k: r"(\d{1,2}+)" for k in "ymdHIMS"}

_DAY_MONTH, _SLASHED, _DASHED, _LOG, _MAIL, _SOLID = "{d}{b}{Y}", "{y}/{m}/{d}", "{Y}-{m}-{d}", "{d}/{b}/{Y}", "{w}, {d} {b} {Y}", "{Y}{m}{d}"
_CLOCK, _SOLID_CLOCK, _HALF_CLOCK = "{H}:{M}:{S}", "{H}{M}{S}", "{p}{I}{M}{S}"
DATES = [_DASHED, _SOLID, _SLASHED, _MAIL, _LOG, _DAY_MONTH, "{d}-{m}-{Y}"]
TIMES = [_CLOCK, _CLOCK + "{f}", _CLOCK + "{f}Z", _CLOCK + "{f}{z}", _CLOCK + "{f} {z}", _CLOCK + "{f} GMT", _SOLID_CLOCK + "{f}", _HALF_CLOCK + "{f}", "{I}:{M} {p}"]
TIMESTAMPS = [
    *(f"{_DASHED}{sep}{_CLOCK}{end}" for sep, ends in (("T", ("", "{f}", "{f}Z", "{f}{z}")), (" ", ("", "{f}", "{f}{z}"))) for end in ends),
    *(day + _CLOCK + end for day, end in ((_SLASHED + " ", ""), (_SLASHED + " ", "{f}"), (_LOG + ":", ""), (_LOG + ":", "{f} {z}"), (_MAIL + " ", ""), (_MAIL + " ", "{f} GMT"))),
    *(x + end for x in (_SOLID + _SOLID_CLOCK, _DAY_MONTH + _HALF_CLOCK) for end in ("", "{f}")),
]


def fields_of(shape: str) -> list[str]:
    return re.findall(r"\{(\w)\}", shape)


def pattern(shape: str) -> str:
    """The regular expression of a shape, with one group for each field."""
    return "^" + re.sub(r"\{(\w)\}", lambda m: FIELDS[m[1]], shape) + "$"


#: The order of fields in the common form that every shape is rewritten to.
ORDER = "YymbdwHIpMSf"


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _common(x: str, shapes: list[str]) -> str:
    """SQL for the fields of text x with bars between them; null if it has none of the shapes."""
    # most texts begin like none of the shapes
    begins = "^(?i:[0-9]|[ap]m[0-9]|(?:" + "|".join(WEEKDAYS) + "),)"
    cases = [f"WHEN NOT {x} RLIKE {_quoted(begins)} THEN NULL"]
    for s in shapes:
        at = {k: i + 1 for i, k in enumerate(fields_of(s))}
        cases.append(f"WHEN {x} RLIKE {_quoted(pattern(s))} THEN regexp_replace({x}, {_quoted(pattern(s))}, '{'|'.join(f'${at[k]}' if k in at else '' for k in ORDER)}')")
    return f"CASE {' '.join(cases)} END"


def _time(p: str) -> str:
    """SQL for the local time that the array p of fields means; null if there is no such day or time. Without a day it is on 2000-01-01."""
    at = {k: f"nullif({p}[{i}], '')" for i, k in enumerate(ORDER)}
    number = {k: f"cast({v} AS int)" for k, v in at.items()}
    name = lambda k, names: f"cast(array_position(array({', '.join(map(repr, names))}), lower({at[k]})) AS int)"
    year = f"coalesce({number['Y']}, {number['y']} + if({number['y']} < 70, 2000, 1900), 2000)"
    half = f"if({number['I']} BETWEEN 1 AND 12, {number['I']} % 12 + if(lower({at['p']}) = 'pm', 12, 0), NULL)"
    hour = f"if({at['I']} IS NOT NULL, {half}, coalesce({number['H']}, 0))"
    second = f"cast(concat(coalesce({at['S']}, '0'), '.', rpad(substring(coalesce({at['f']}, ''), 1, 6), 6, '0')) AS decimal(16,6))"
    made = f"try_make_timestamp_ntz({year}, coalesce({name('b', MONTHS)}, {number['m']}, 1), coalesce({number['d']}, 1), {hour}, coalesce({number['M']}, 0), {second})"
    return f"transform(array({made}), t -> if({p} IS NOT NULL AND ({at['w']} IS NULL OR dayofweek(t) = {name('w', WEEKDAYS)}), t, NULL))[0]"


def local_time(x: str, shapes: list[str]) -> str:
    """SQL for the time that text x means in one of the shapes. What is read many times is bound once, in a lambda."""
    return f"transform(array(split({_common(x, shapes)}, '[|]')), p -> {_time('p')})[0]"


DATE_SQL, TIMESTAMP_SQL = "cast({} AS date)", "{}"
CLOCK_SQL = "transform(array({}), t -> cast(hour(t) * 3600000 + minute(t) * 60000 + cast(extract(SECOND FROM t) * 1000 AS int) AS long))[0]"


def as_date(x: str) -> str:
    return DATE_SQL.format(local_time(x, DATES))


def as_timestamp(x: str) -> str:
    return local_time(x, TIMESTAMPS)


def as_time(x: str) -> str:
    return CLOCK_SQL.format(local_time(x, TIMES))


def bound(c: Column, sql: str) -> Column:
    """An SQL expression over x, where x is a column."""
    return F.element_at(F.call_function("transform", F.array(c), F.expr(f"x -> {sql}")), 1)


def to_date(c: Column) -> Column:
    return bound(c, as_date("x"))


def to_timestamp(c: Column) -> Column:
    """Local wall-clock time; an offset at the end is dropped."""
    return bound(c, as_timestamp("x"))


def to_time(c: Column) -> Column:
    """Milliseconds of the day."""
    return bound(c, as_time("x"))
