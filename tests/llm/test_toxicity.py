import math
import unicodedata
from collections import Counter

import numpy as np
import pytest
import regex

from tallyloom.llm import toxicity


def test_thresholds_are_ordered_and_share_weights():
    rng = np.random.default_rng(3)
    docs, toxic = [], []
    for _ in range(600):
        bad = rng.random() < 0.3
        words = {b"plain%d" % rng.integers(0, 60): 1 for _ in range(20)}
        if bad:
            words |= {b"insult%d" % k: 1 for k in range(int(rng.integers(1, 7)))}
        docs.append(list(words.items()))
        toxic.append(bad)
    model = toxicity.train(docs, np.array(toxic))
    assert (np.diff(model.thetas) >= 0).all()
    score = np.array([sum(model.words([w])[0] for w, _ in d) for d in docs])
    p = model.above(score)
    assert (np.diff(p, axis=1) <= 1e-12).all()
    assert ((p[:, 0] >= model.cut) == np.array(toxic)).mean() > 0.97


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("crc32(cast(doc_id AS string)) % 5 <> 1"))
    held = labels.where("crc32(cast(doc_id AS string)) % 5 = 1").selectExpr("doc_id", "toxic AS label")
    rows = toxicity.grade_documents(docs, model).join(held, "doc_id").collect()
    caught = sum(r.toxic for r in rows if r.label) / sum(1 for r in rows if r.label)
    wrong = sum(r.toxic for r in rows if not r.label) / sum(1 for r in rows if not r.label)
    assert caught > 0.9 and wrong < 0.01
    for r in rows:
        assert abs(r.expected_severity - (r.p_mild + r.p_marked + r.p_severe)) < 1e-5 and (r.grade > 0) == r.toxic


def test_scores_by_brute_force(spark, awkward, sf):
    """Scores, probabilities and grades of whole texts, word by word."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    for frame in (docs, awkward):
        texts = sorted((str(r.doc_id), r.text or "") for r in frame.collect())
        got = sorted((str(r.doc_id), r) for r in toxicity.grade_documents(frame, model).collect())
        want = []
        for i, t in texts:
            words = pattern.findall("".join(c if c == "Σ" else c.lower() for c in unicodedata.normalize("NFC", t)).replace("Σ", "σ"))
            score = sum(min(n, 3) * sum(model.weights[f] for f in toxicity.token_features(w.encode())) for w, n in Counter(words).items())
            p = [1 / (1 + math.exp(-max(-40, min(40, score - theta)))) for theta in model.thetas]
            toxic = p[0] >= model.cut
            want.append((i, len(words), max(1, sum(x >= 0.5 for x in p)) if toxic else 0, score, sum(p)))
        found = sorted((i, r.n_words, r.grade, r.score, r.expected_severity) for i, r in got)
        for a, b in zip(sorted(want), found, strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-5)


def test_edges(spark, awkward, empty, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert toxicity.grade_documents(awkward, model).count() == awkward.count()
    assert toxicity.grade_documents(empty, model).collect() == []
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.grade_documents(awkward, toxicity.fit(docs, none)).where("toxic").count() == 0
