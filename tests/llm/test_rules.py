import re
import unicodedata
from collections import Counter

import numpy as np

from tallyloom.llm import rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def key(r):
    return tuple(map(str, r))


def test_statistics(spark, awkward, empty, sf):
    for docs in (awkward, spark.read.parquet(f"{sf}/documents.parquet")):
        want = sorted(((i, *brute(t)) for i, t in docs.select("doc_id", "text").collect()), key=key)
        assert sorted((tuple(r)[:6] for r in rules.statistics(docs).collect()), key=key) == want
    assert rules.statistics(empty).collect() == []


def test_long_texts_in_pieces(spark, awkward, sf, monkeypatch):
    # a text of tens of millions of words doesn't fit an executor as an array of words
    monkeypatch.setattr(rules, "LONG", 40)
    whole = spark.read.parquet(f"{sf}/documents.parquet").limit(25).select("doc_id", "text").unionByName(awkward.where("doc_id < 100 OR doc_id IS NULL").select("doc_id", "text"))
    odd = spark.createDataFrame([(-1, "é中 ñ\x85Σ " * 40 + "\n\n \n"), (-2, "\n" * 300), (-3, "ab\ncd " * 60), (-4, " " * 50 + "w" * 300), (-5, "a b c\r\n" * 9 + "É!?" * 30)], "doc_id long, text string")
    docs = whole.unionByName(odd).unionByName(odd)
    want = sorted(((i, *brute(t), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n")), sum(unicodedata.category(c) == "Lu" for c in t or ""), sum(c in "!?" for c in t or "")) for i, t in docs.collect()), key=key)
    for piece in (7, 64):
        monkeypatch.setattr(rules, "PIECE", piece)
        assert sorted((tuple(r) for r in rules.statistics(docs).collect()), key=key) == want


def test_statistics_can_be_filtered(spark, awkward):
    # a filter that is pushed into the projection would take hours on the long text
    assert rules.statistics(awkward).where("n_repeat_words > 5").count() > 0


def test_a_list_is_learned():
    rng = np.random.default_rng(1)
    n = 3000
    data = {f: rng.random(n) for f in rules.FEATURES}
    bad = (data["symbols_per_word"] > 0.8) | ((data["duplicate_lines"] > 0.6) & (data["capitals_per_char"] <= 0.3))
    found = rules.learn(data, bad)
    caught = np.zeros(n, bool)
    for rule in found:
        caught |= rules.holds(rule, data)
    assert (caught == bad).mean() > 0.98
    assert rules.learn(data, np.zeros(n, bool)) == [] and len(rules.learn(data, np.ones(n, bool))) <= 1


def test_judgement(spark, awkward, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = rules.judge(docs, labels)
    assert not re.search("Python|Pandas|Arrow|RDD", out._jdf.queryExecution().executedPlan().toString())
    learned = rules.learn_rules(docs, labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    wrong = {0: 0, 1: 0}
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        share = lambda a, b: np.array([a / b if b else 0.0])
        data = {"mean_word_chars": share(r.word_chars, r.n_words), "symbols_per_word": share(r.n_symbols, r.n_words), "duplicate_lines": share(r.n_dup_lines, r.n_lines), "repeated_words": share(r.n_repeat_words, r.n_words), "capitals_per_char": share(r.n_capitals, r.word_chars), "marks_per_word": share(r.n_marks, r.n_words), "words": np.array([r.n_words])}
        first = next((k for k, rule in enumerate(learned) if rules.holds(rule, data)[0]), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)
        if r.doc_id in quality and not r.base_failed:
            wrong[quality[r.doc_id]] += r.kept != (quality[r.doc_id] == 1)
    assert wrong[1] == 0 and wrong[0] <= 2
    assert {str(r.doc_id) for r in rules.judge(awkward, labels).collect()} == {str(r.doc_id) for r in awkward.collect()}
    assert rules.judge(empty, labels).collect() == []
    assert rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_kept_rows_are_whole(spark, awkward, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = rules.keep_documents(awkward, rules.learn_rules(awkward, labels))
    assert kept.columns == awkward.columns
    want = {str(r.doc_id) for r in rules.judge(awkward, labels).where("kept").collect()}
    assert {str(r.doc_id) for r in kept.collect()} == want and want
