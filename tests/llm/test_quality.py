import numpy as np
import pytest
import xxhash
import regex
import public_tokenizers

from tallyloom.llm import quality


def ngrams(text):
    h = [xxhash.xxh64_intdigest(w.encode()) for w in regex.findall(public_tokenizers.PATTERN, text or "")]
    out = list(h)
    for a, b in zip(h, h[1:]):
        x = (a * 0x9E3779B97F4A7C15 % 2**64) ^ (b * 0xC2B2AE3D27D4EB4F % 2**64)
        out.append(x ^ (x >> 29))
    return [x % quality.BUCKETS for x in out]


def test_weights_follow_the_models(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality}
    raw, aimed = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t in texts.items():
        b = np.bincount(ngrams(t), minlength=quality.BUCKETS)
        raw += b
        aimed += b * (i in good)
    ratio = np.log(aimed / aimed.sum()) - np.log(raw / raw.sum())
    out = quality.resample(docs, labels).collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        b = ngrams(texts[r.doc_id])
        assert r.n_ngrams == len(b) and r.log_weight == pytest.approx(ratio[b].sum(), abs=1e-4)
    kept = sorted((r.sample_key for r in out), reverse=True)[: sum(r.kept for r in out)]
    assert all(r.kept == (r.sample_key >= kept[-1]) for r in out)


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.resample(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id")
    share = {r.quality: r.share for r in out.groupBy("quality").agg({"kept": "count"}).join(out.where("kept").groupBy("quality").count(), "quality").selectExpr("quality", "count / `count(kept)` AS share").collect()}
    assert share[1] >= 0.99 and share.get(0, 0) <= 0.1


def test_share_and_edges(spark, awkward, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = quality.resample(awkward, labels, keep_share=0.5)
    n = awkward.count()
    keys = sorted((r.sample_key for r in half.collect()), reverse=True)
    assert half.where("kept").count() == sum(k >= keys[round(n / 2) - 1] for k in keys)
    assert quality.resample(empty, labels).collect() == []
    assert quality.resample(awkward, labels.limit(0)).where("NOT kept").count() == 0
    kept = quality.keep_documents(awkward, labels)
    assert kept.columns == awkward.columns
    assert quality.keep_documents(empty, labels).collect() == []


def test_the_kth_largest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 8)
    values = np.round(np.random.default_rng(4).normal(size=400) ** 5, 3).tolist() + [2.5] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 37, 225, 449, 450):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
