"""Learned decision lists over text statistics, as Spark conditional expressions (3).

Main path: SQL functions only. Statistics of a bounded sample of labelled documents come to
the driver, where sequential covering grows and prunes the rules; what runs over the corpus
is one conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of

#: At most so many labelled documents teach the rules: those with the smallest hashes of their ids.
SAMPLE = 10_000
WORD = r"[^\\x20\\x09-\\x0D]"
#: Statistics a rule may test: what they are called, and how they follow from the columns.
FEATURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "capitals_per_char": "n_capitals / word_chars",
    "marks_per_word": "n_marks / n_words",
    "words": "n_words",
}


#: Always 0, which the optimizer can't know: a filter on a column that holds it stays above the
#: projection. Pushed below, it would put the array expressions into the lambdas that read them, once per element.
BARRIER = "if(monotonically_increasing_id() < 0, 1L, 0L)"
#: Texts of more than LONG bytes aren't held as arrays of words in one row: they are looked at in pieces of PIECE bytes.
LONG, PIECE = 4 << 20, 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    r"""Statistics of every whole text; words are [^\x20\x09-\x0D]+, a null text has none.

    Repeated three-word windows are found by sorting each text's own window hashes
    (64 bits) with their places: neighbours of equal hash repeat, and the words
    that the repeated windows cover are counted from the gaps between their places. So a
    text costs n log n, and nothing is shuffled. The few texts of more than LONG bytes, whose
    words would fill an executor's memory, are counted by `in_pieces` instead.
    """
    base = docs.select("doc_id", *keep, F.expr("coalesce(cast(text AS string), '')").alias("t"))
    return in_rows(base.where(f"octet_length(t) <= {LONG}"), *keep).unionAll(in_pieces(base.where(f"octet_length(t) > {LONG}"), *keep))


def in_rows(base: DataFrame, *keep: str) -> DataFrame:
    """Statistics of texts t, each in its row."""
    split = base.select("doc_id", *keep, "t", F.expr(r"array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')").alias("w"), F.expr(rf"filter(split(t, '\n'), x -> x RLIKE '{WORD}')").alias("lines"))
    hashed = split.select(
        "doc_id",
        *keep,
        F.expr("cast(size(w) AS long)").alias("n_words"),
        F.expr("cast(char_length(array_join(w, '')) AS long)").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') AS long)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS long)").alias("n_dup_lines"),
        F.expr("cast(size(lines) AS long)").alias("n_lines"),
        F.expr(r"cast(regexp_count(t, '\\p{Lu}') AS long)").alias("n_capitals"),
        F.expr("cast(regexp_count(t, '[!?]') AS long)").alias("n_marks"),
        F.expr("CASE WHEN size(w) < 3 THEN array() ELSE sort_array(transform(sequence(1, size(w) - 2), i -> struct(xxhash64(w[i - 1], w[i], w[i + 1]) AS h, i AS p))) END").alias("s"),
    )
    placed = hashed.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].h = x.h) OR (i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].h = x.h)), x -> x.p))"))
    covered = F.expr("aggregate(p, named_struct('n', 0L, 'at', -3), (a, x) -> named_struct('n', a.n + cast(least(3, x - a.at) AS long), 'at', x), a -> a.n)")
    return placed.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", (covered + F.expr(BARRIER)).alias("n_repeat_words"), "n_lines", "n_capitals", "n_marks")


def between(texts: DataFrame, ends: str) -> DataFrame:
    """digest, p and x: the texts' bytes (as Latin-1) in pieces p. A run of bytes outside the class `ends` is whole, in the piece where it begins."""
    bytes_ = lambda at, n: f"decode(substring(b, {at}, {n}), 'ISO-8859-1')"
    own, after = bytes_(f"p * {PIECE} + 1", PIECE), bytes_(f"(p + 1) * {PIECE} + 1", PIECE)
    goes_on = f"p > 0 AND NOT {bytes_(f'p * {PIECE}', 1)} RLIKE '[{ends}]'"  # the piece begins inside a run
    head = lambda x: f"regexp_extract({x}, '^[^{ends}]*', 0)"
    rest = f"CASE WHEN {bytes_(f'(p + 1) * {PIECE}', 1)} RLIKE '[{ends}]' THEN '' WHEN {after} RLIKE '[{ends}]' THEN {head(after)} ELSE {head(bytes_(f'(p + 1) * {PIECE} + 1', 'octet_length(b)'))} END"
    x = f"CASE WHEN {goes_on} THEN CASE WHEN {own} RLIKE '[{ends}]' THEN concat(regexp_replace({own}, '^[^{ends}]*', ''), {rest}) ELSE '' END ELSE concat({own}, {rest}) END"
    pieces = F.expr(f"transform(sequence(0L, cast((octet_length(b) - 1) div {PIECE} AS long)), p -> struct(p, {x} AS x))")
    return texts.select("digest", F.col("t").cast("binary").alias("b")).select("digest", F.explode(pieces).alias("s")).select("digest", "s.p", "s.x")


def in_pieces(base: DataFrame, *keep: str) -> DataFrame:
    """The same statistics of long texts t: a text's words and lines are rows, told apart by its digest, so a sort may go to disk."""
    white = r"\\x20\\x09-\\x0D"
    removed = lambda those: F.expr(f"cast(char_length(t) - char_length(regexp_replace(t, '{those}', '')) AS long)")
    rows = base.withColumn("digest", F.sha2("t", 256))
    texts = rows.groupBy("digest").agg(F.min("t").alias("t"))
    words = between(texts, white).select("digest", "p", F.posexplode(F.expr(f"array_remove(split(x, '[{white}]+'), '')")).alias("i", "w"))
    order = Window.partitionBy("digest").orderBy("p", "i")
    windows = words.select("digest", F.row_number().over(order).alias("at"), F.xxhash64("w", F.lead("w", 1).over(order), F.lead("w", 2).over(order)).alias("h"), F.lead("w", 2).over(order).isNotNull().alias("whole"))
    often = windows.withColumn("n", F.count("*").over(Window.partitionBy("digest", "whole", "h")))
    places = often.where("whole AND n > 1").withColumn("last", F.lag("at").over(Window.partitionBy("digest").orderBy("at")))
    covered = places.groupBy("digest").agg(F.sum(F.expr("least(3, coalesce(at - last, 3))")).alias("n_repeat_words"))
    counted = words.groupBy("digest").agg(F.count("*").alias("n_words"))
    lines = between(texts, r"\\n").select("digest", F.explode(F.expr(rf"filter(split(x, '\n'), y -> y RLIKE '{WORD}')")).alias("line")).groupBy("digest", F.sha2("line", 256).alias("line")).agg(F.count("*").alias("n"))
    repeated = lines.groupBy("digest").agg(F.sum("n").alias("n_lines"), F.sum(F.col("n") - 1).alias("n_dup_lines"))
    known = counted.join(covered, "digest", "left").join(repeated, "digest", "left")
    scalars = rows.select("doc_id", *keep, "digest", F.expr(f"cast(char_length(regexp_replace(t, '[{white}]+', '')) AS long)").alias("word_chars"), removed("[#*$%&|<>]").alias("n_symbols"), removed(r"\\p{Lu}").alias("n_capitals"), removed("[!?]").alias("n_marks"))
    return scalars.join(known, "digest", "left").select("doc_id", *keep, *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in COUNTS))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def feature(name: str) -> Column:
    return F.expr(f"coalesce(try_divide({', '.join(FEATURES[name].split(' / '))}), 0D)" if "/" in FEATURES[name] else f"cast({FEATURES[name]} AS double)")


# --- learning ------------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return feature(self.feature) > self.bound if self.above else feature(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Test, ...]


def holds(rule: Rule, data: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(data.values()))), bool)
    for t in rule:
        out &= data[t.feature] > t.bound if t.above else data[t.feature] <= t.bound
    return out


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, bins: int, most: int) -> Rule:
    """Adds the test of largest information gain until no good example is covered."""
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < most and (covered & ~bad).any():
        p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
        before, best, gain = np.log2(p0 / (p0 + n0)), None, 0.0
        for name, x in data.items():
            bounds = np.unique(np.quantile(x[covered], np.linspace(0, 1, bins + 1), method="lower"))
            order = np.searchsorted(bounds, x[covered], "left")  # the first bound that isn't below x
            p = np.cumsum(np.bincount(order[bad[covered]], minlength=len(bounds)))
            n = np.cumsum(np.bincount(order[~bad[covered]], minlength=len(bounds)))
            for above, pos, neg in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain + 1e-9:
                    beyond = x[covered][x[covered] > bounds[k]]  # the bound lies midway to the next value
                    best, gain = Test(name, above, float((bounds[k] + beyond.min()) / 2 if len(beyond) else bounds[k])), float(g[k])
        if best is None:
            break
        rule += (best,)
        covered &= holds((best,), data)
    return rule


def _worth(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = holds(rule, data)
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(data: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5, bins: int = 64, most_tests: int = 4, most_rules: int = 24) -> list[Rule]:
    """Rules for bad examples, in order: each is grown on two thirds, pruned on the rest, and
    kept if it covers `least` examples with `precision`; what it covers is then set aside.
    No example of either kind: no rule."""
    rules: list[Rule] = []
    live = np.ones(len(bad), bool)
    while len(rules) < most_rules and (live & bad).sum() >= least:
        index = np.flatnonzero(live)
        grow, prune = index[np.arange(len(index)) % 3 != 2], index[np.arange(len(index)) % 3 == 2]
        part = lambda where: ({k: v[where] for k, v in data.items()}, bad[where])
        if not bad[grow].any():
            break
        rule = _grow(*part(grow), bins, most_tests)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, *part(prune)))
        covered = live & holds(rule, data)
        if covered.sum() < least or (covered & bad).sum() < precision * covered.sum():
            break
        rules.append(rule)
        live &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the number of the first rule that holds, null where none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        test = rule[0].column()
        for t in rule[1:]:
            test &= t.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def labelled_sample(labels: DataFrame, size: int) -> DataFrame:
    """At most `size` labelled ids, those with the smallest hashes; a disputed id counts as good."""
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The decision list for documents of quality 0 that pass the base test."""
    chosen = labelled_sample(labels, sample).collect()
    if not chosen:
        return []
    quality = {r.doc_id: r.quality for r in chosen}
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = plain.where(F.col("doc_id").isin(list(quality))).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = statistics(few).where(~base_failed()).select("doc_id", *(feature(f).alias(f) for f in FEATURES)).orderBy(F.xxhash64("doc_id")).collect()
    if not rows:
        return []
    data = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn(data, np.array([quality[r.doc_id] == 0 for r in rows]))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics, base_failed, rule (the number of the rule that rejects, else null) and kept of every document.

    Null and empty texts have no words and fail the base test; repeated rows are judged
    alike. With no labels there are no rules, and the base test decides alone.
    """
    rules = learn_rules(docs, labels, sample)
    out = statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr("NOT base_failed AND rule IS NULL").alias("kept"), "rule", "n_lines", "n_capitals", "n_marks")


def keep_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that the base test and the rules keep, with all of their columns.

    Each row is judged by its own text, whatever its id. Null, empty and short texts fail the base test and go;
    without rules the base test decides alone.
    """
    row = F.struct(*columns_of(docs)).alias("row")
    judged = statistics(docs.select("doc_id", "text", row), "row").where(~base_failed()).where(verdict(rules).isNull())
    return judged.select("row.*")
