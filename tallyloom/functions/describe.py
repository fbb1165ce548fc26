"""Fields as paragraphs, and paragraphs as vectors by feature hashing."""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

DIM = 384
#: Number text of quantiles: which of the eleven are told, and as what.
TOLD = ((0, "P10"), (2, "P25"), (5, "median"), (7, "P75"), (10, "P90"))


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def number(x: float) -> str:
    """A number without a fraction that says nothing."""
    if math.isnan(x) or math.isinf(x):
        return str(x)
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def type_sentence(kind: str, confidence: float | None) -> str:
    hedge = "It is " if confidence is not None and confidence > 0.65 else "It may be "
    family, _, inside = kind.partition("(")
    unit = {"s": "seconds", "ms": "milliseconds", "us": "microseconds", "ns": "nanoseconds"}.get(inside[:-1], inside[:-1])
    if re.fullmatch("U?Int(8|16|32|64)", kind):
        what = f"a whole number stored as {kind}"
    elif re.fullmatch("Float(16|32|64)", kind):
        what = f"a measured number stored as {kind}"
    elif kind == "FixedSizeBinary(16)":
        what = "a universally unique identifier"
    elif family in ("Time32", "Time64"):
        what = f"a time of day in {unit}"
    elif family == "Timestamp":
        what = f"a moment in time, resolved to {unit}"
    else:
        what = {"Date32": "a day of the calendar", "Boolean": "true or false", "Null": "always missing", "Binary": "raw bytes", "LargeBinary": "raw bytes", "FixedSizeBinary": f"{inside[:-1]} raw bytes", "List": "a list", "Utf8": "text", "LargeUtf8": "text", "Utf8View": "text"}.get(family, f"a compound value of type {kind}")
    return f"{hedge}{what}."


def numeric_sentence(s) -> str:
    low = s.min_val if s.min_val is not None else s.char_min_length
    high = s.max_val if s.max_val is not None else s.char_max_length
    parts = [f"smallest {number(low)}"] if low is not None else []
    parts += [f"{name} {number(s.quantiles[i])}" for i, name in TOLD] if s.quantiles else []
    parts += [f"largest {number(high)}"] if high is not None else []
    return f"Measured: {', '.join(parts)}." if parts else ""


def cardinality_sentence(ratio: float | None) -> str:
    if ratio is None:
        return ""
    return "Nearly every value is different." if ratio > 0.89 else "Many values are different." if ratio > 0.49 else "Values come back often." if ratio > 0.009 else "Only a few values take turns."


def char_class_sentence(shares: list[float] | None) -> str:
    """What the characters say: the first rule that holds."""
    if shares is None:
        return ""
    digit, letter, blank, mark, other = shares
    rules = (
        (digit > 0.8 and letter < 0.1 and other < 0.1, "Mostly digits: numbers or numeric codes."),
        (digit > 0.5 and letter > 0.3, "Digits among letters: alphanumeric codes."),
        (letter > 0.8 and blank < 0.1, "Mostly single words: labels or categories."),
        (letter > 0.7 and blank > 0.1, "Words and blanks: names or free text."),
        (other > 0.5, "Mostly unusual characters: encoded or escaped content."),
        (other > 0.3, "Many unusual characters: encoded content."),
        (mark > 0.3 and digit > 0.3, "Digits and marks: dates, versions or formatted numbers."),
        (blank > 0.5, "Mostly blanks: sparse content."),
        (digit > 0.3 and letter > 0.3 and other > 0.2, "All kinds of characters: hashes or tokens."),
    )
    return next((text for holds, text in rules if holds), "No kind of character stands out.")


def _shape(x: float | None, low: str, high: str, flat: str) -> str:
    return "" if x is None or math.isnan(x) else low if x <= -0.1 else high if x >= 0.1 else flat


def paragraph(kind: str, confidence: float | None, nullable: bool, stats, default: str | None = None, char_max_length: int | None = None, numeric_precision: int | None = None, numeric_scale: int | None = None, datetime_precision: int | None = None) -> str:
    """What is known of a field, in sentences; its name is left out, for names may say little.

    stats is a FieldStats or None. The skew sentence follows the skewness, that on outliers the kurtosis.
    """
    say = [type_sentence(kind, confidence)]
    if stats is not None:
        say += [numeric_sentence(stats), cardinality_sentence(stats.cardinality), "In order, its values rise: a sequence." if stats.is_monotonic else ""]
    say.append("Values may be missing." if nullable else "No value may be missing.")
    say.append(f"Its default is '{default}'." if default is not None else "")
    if stats is not None and stats.avg > 0:
        say.append(f"A typical value has size {number(round(stats.avg, 2))}.")
    for n, text in ((char_max_length, "At most {} characters."), (numeric_precision, "{} digits in all."), (numeric_scale, "{} digits after the point."), (datetime_precision, "Times have {} digits of a second.")):
        say.append(text.format(n) if n is not None else "")
    if stats is not None:
        say += [_shape(stats.skewness, "It leans left.", "It leans right.", "It is symmetric."), _shape(stats.kurtosis, "Outliers are rare.", "Outliers are common.", "Outliers are as in a bell curve."), char_class_sentence(stats.char_classes)]
    return " ".join(x for x in say if x)


def hashed(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """Signed feature hashing of words and of pairs of neighbours, of length one; equal texts have equal vectors."""
    out = []
    for t in texts:
        v = [0.0] * dim
        words = re.findall(r"[a-z0-9]+", t.lower())
        for token in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in v))
        out.append([x / size for x in v] if size >= 1e-8 else v)
    return out
