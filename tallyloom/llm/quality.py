"""Importance resampling of documents: target against raw n-gram models, Gumbel top-k (6)."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from . import blocks
from .common import appended, columns_of, fresh, id_text, written

#: Buckets of hashed n-grams (pre-tokens and pairs of neighbours).
BUCKETS = 1 << 16
#: At most so many labelled documents make the target model and set the share to keep: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: What losing a good labelled document costs against keeping a bad one, when the share is set.
COST = 5.0
BINS = 4096


def buckets_of(texts: blocks.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, ragged: a text of n pre-tokens has n + max(0, n - 1)."""
    words = blocks.byte_level_tokens(texts)
    codes, distinct = words.encode()
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    n = np.diff(words.docs)
    ends = np.append(0, np.cumsum(n + np.maximum(n - 1, 0)))
    out = np.empty(int(ends[-1]), np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(one)) - words.docs[doc] + ends[doc]
    out[at] = one
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        two = (one[inner] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[inner + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        two ^= two >> np.uint64(29)
    out[at[inner] + n[doc[inner]]] = two
    return (out & np.uint64(BUCKETS - 1)).astype(np.int64), ends


def sample_labels(labels: DataFrame, size: int) -> dict[int, int]:
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return {r.doc_id: r.quality for r in each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()}


def log_ratios(docs: DataFrame, target: np.ndarray) -> np.ndarray:
    """log p_target(bucket) - log p_raw(bucket): n-grams of the target ids, and of all documents, with one added to each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aimed = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in blocks.blocks(batch):
                bucket, ends = buckets_of(blocks.texts_of(part.column(1)))
                raw += np.bincount(bucket, minlength=BUCKETS)
                chosen = np.isin(part.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False), target)
                aimed += np.bincount(bucket[np.repeat(chosen, np.diff(ends))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        for k in range(0, len(some), 10_000):
            at = some[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(aimed[at])], ["bucket", "raw", "aimed"])

    rows = id_text(docs).mapInArrow(count, "bucket int, raw long, aimed long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aimed").alias("aimed")).collect()
    raw, aimed = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        raw[r.bucket] += r.raw
        aimed[r.bucket] += r.aimed
    return np.log(aimed / aimed.sum()) - np.log(raw / raw.sum())


def gumbel(seed: int) -> Column:
    """A standard Gumbel number that depends on the id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: counts in bins, then in the bins of the bin that holds it."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    inside = df
    while True:
        if low == high:
            return low
        width = (high - low) / BINS
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(number.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(counts, reverse=True):
            n, bottom, top = counts[b]
            if k <= n:
                break
            k -= n
        if n <= BINS:
            return sorted((r[0] for r in inside.where(F.col(column).between(bottom, top)).select(column).collect()), reverse=True)[k - 1]
        low, high = bottom, top
        inside = df.where(F.col(column).between(low, high))


def bar(good: np.ndarray, bad: np.ndarray) -> float:
    """The value that parts good from bad at the least cost; below all of the good where there is no bad."""
    if not len(good):
        return -np.inf
    if not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    bounds = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1)
    bounds = np.insert(bounds, 0, values[0] - 1)
    lost = np.searchsorted(np.sort(good), bounds) * COST + len(bad) - np.searchsorted(np.sort(bad), bounds)
    return float(bounds[np.argmin(lost)])


def weighed(docs: DataFrame, labels: DataFrame, names: list[str], sample: int, seed: int, keep_share: float | None) -> DataFrame:
    """The rows of docs, whole, with the columns of these names for n_ngrams, log_weight, sample_key and kept."""
    quality = sample_labels(labels, sample)
    target = np.array(sorted(i for i, q in quality.items() if q), np.int64)
    ratios = log_ratios(docs, target) if len(target) else np.zeros(BUCKETS)

    def score(pair: pa.RecordBatch) -> list[pa.Array]:
        bucket, ends = buckets_of(blocks.texts_of(pair.column(1)))
        return [pa.array(np.diff(ends)), pa.array(np.round(blocks.row_sums(ratios[bucket], ends), 6))]

    count, weight, key, kept = names
    scored = written(appended(docs, score, [StructField(count, LongType()), StructField(weight, DoubleType())]).withColumn(key, F.col(weight) + gumbel(seed)))
    plain = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(weight).alias("w"), F.col(key).alias("key"))
    n = plain.count()
    threshold = float("-inf")
    if n and len(target):
        if keep_share is None:
            known = plain.where(F.col("doc_id").isin(list(quality))).groupBy("doc_id").agg(F.min("w").alias("w")).collect()
            at = bar(np.array([r.w for r in known if quality[r.doc_id]]), np.array([r.w for r in known if not quality[r.doc_id]]))
            k = plain.where(F.col("w") >= at).count() if np.isfinite(at) else n
        else:
            k = round(keep_share * n)
        threshold = kth_largest(plain, "key", k) if k else float("inf")
    return scored.withColumn(kept, F.col(key) >= F.lit(threshold))


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7, keep_share: float | None = None) -> DataFrame:
    """doc_id, n_ngrams, log_weight, sample_key and kept of every document.

    log_weight sums, over all n-grams of the whole text, log target minus log raw
    probability; sample_key adds Gumbel noise, and the documents of the k largest
    keys are kept: a sample without replacement in proportion to the weights. k is
    keep_share of the documents; by default the share of all documents whose weight clears
    the bar that best parts the labelled sample. Equal keys at the bar are all kept. A null or empty
    text has weight 0. Each row is weighed by its own text; rows of one id, and all without an id, share their noise.
    Without good labels nothing is known of the target: every weight is 0 and all are kept.
    """
    names = ["n_ngrams", "log_weight", "sample_key", "kept"]
    return weighed(id_text(docs), labels, names, sample, seed, keep_share).select("doc_id", *names)


def keep_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """The rows of docs, with all of their columns, that `resample` keeps: each by its own text, also where ids repeat or are null."""
    names = fresh(docs.columns, "n_ngrams", "log_weight", "sample_key", "kept")
    return weighed(docs, labels, names, sample, seed, None).where(F.col(names[3])).select(*columns_of(docs))
