"""Severity of toxic text by cumulative-link ordinal regression (2)."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import id_text, per_block

#: At most so many labelled documents of each label teach the model: those with the smallest hashes of their ids.
SAMPLE = (2_000, 6_000)  # toxic, clean
FEATURES = 1 << 18
#: Byte lengths of the word beginnings that are features beside the whole word.
PREFIXES = (5, 6, 7, 8)
GRADES = 4  # 0 is clean


def token_features(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings."""
    mask = FEATURES - 1
    out = [xxhash.xxh64_intdigest(word, 1) & mask]
    out += [xxhash.xxh64_intdigest(word[:n], 100 + n) & mask for n in PREFIXES if len(word) >= n]
    return out


def tokens(texts: blocks.Texts) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes, distinct words in lower case without punctuation, and each text's first word."""
    words = blocks.word_level_tokens(blocks.normalised(texts))
    codes, distinct = words.encode()
    return codes, distinct.to_pylist(), words.docs


class Severity:
    """P(grade > k) = sigmoid(x.w - theta_k): one weight vector, ordered thresholds."""

    def __init__(self, weights: np.ndarray, thetas: np.ndarray, cut: float):
        self.weights, self.thetas, self.cut = weights, thetas, cut

    def words(self, distinct: list[bytes]) -> np.ndarray:
        return np.fromiter((self.weights[token_features(w)].sum() for w in distinct), np.float64, len(distinct))

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thetas[None, :], -40, 40)))


def train(docs: list[list[tuple[bytes, int]]], toxic: np.ndarray, rounds: int = 300, rate: float = 0.3, penalty: float = 2e-4) -> Severity:
    """docs: the distinct words of each with their counts. Grades are graded labels: a toxic
    document's grade grows with its number of words that occur almost only in toxic ones (0-1, 2-4, 5 and more)."""
    n = len(docs)
    vocabulary: dict[bytes, int] = {}
    rows = np.repeat(np.arange(n), [len(d) for d in docs])
    cols = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for d in docs for w, _ in d), np.int64, len(rows))
    counts = np.fromiter((min(c, 3) for d in docs for _, c in d), np.float64, len(rows))
    words = list(vocabulary)
    per_word = [token_features(w) for w in words]
    sizes = np.fromiter(map(len, per_word), np.int64, len(words))
    flat = np.fromiter((f for x in per_word for f in x), np.int64, int(sizes.sum()))
    ends = np.append(0, np.cumsum(sizes))
    feature, at = blocks.ragged(flat, ends, cols)
    row = np.repeat(rows, np.diff(at))
    value = np.repeat(counts, np.diff(at))
    # a fifth is held out and chooses the cut; what is useful is seen in the others alone
    held = np.arange(n) % 5 == 0
    learn = ~held
    # features that are in several documents, and much more often in toxic ones
    pair = np.unique(row * FEATURES + feature)
    pair = pair[learn[pair // FEATURES]]
    df = np.bincount(pair % FEATURES, minlength=FEATURES)
    tox = np.bincount(pair[toxic[pair // FEATURES]] % FEATURES, minlength=FEATURES)
    base = toxic[learn].mean() if learn.any() else 0.0
    useful = (df >= 4) & (tox > 2 * base * df)
    strong = (df >= 5) & (tox >= 0.9 * df)
    hits = np.zeros(n)
    first = at[:-1]  # a word's own hash comes first
    own = strong[feature[first]] if len(first) else np.zeros(0, bool)
    np.add.at(hits, rows[own], counts[own])
    grade = np.where(toxic, 1 + (hits >= 2) + (hits >= 5), 0)
    keep = useful[feature]
    row, feature, value = row[keep], feature[keep], value[keep]
    used, column = np.unique(feature, return_inverse=True)
    w, theta = np.zeros(len(used)), np.arange(GRADES - 1) + 1.0
    model = Severity(np.zeros(FEATURES), theta, 0.5)
    if not n or not toxic.any() or toxic.all() or not len(used):
        return Severity(np.zeros(FEATURES), np.full(GRADES - 1, 40.0) if not toxic.any() else theta, 0.5)
    square_w, square_t = np.full(len(used), 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, w[column] * value, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        mass = np.maximum(edge[i, grade] - edge[i, grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        up = slope[i, grade] / mass * learn / learn.sum()
        down = slope[i, grade + 1] / mass * learn / learn.sum()
        grad = -np.bincount(column, (up - down)[row] * value, minlength=len(used))
        grad_t = np.zeros(GRADES - 1)
        np.add.at(grad_t, grade[grade > 0] - 1, up[grade > 0])
        np.add.at(grad_t, grade[grade < GRADES - 1], -down[grade < GRADES - 1])
        square_w += grad**2
        square_t += grad_t**2
        w -= rate * grad / np.sqrt(square_w)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty / np.sqrt(square_w), 0)
        theta = np.sort(theta - rate * grad_t / np.sqrt(square_t))
    model.weights[used], model.thetas = w, theta
    score = np.bincount(row, w[column] * value, minlength=n)
    p = 1 / (1 + np.exp(-np.clip(score - theta[0], -40, 40)))
    cuts = np.linspace(0.05, 0.95, 37)
    right = [((p >= c) & toxic & held).sum() / max(1, ((p >= c) & held).sum() + (toxic & held).sum()) for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    model.cut = float(cuts[best[len(best) // 2]])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Severity:
    """Trains in one task on the bounded sample; the weights that aren't 0 come to the driver.

    Of rows of one id the smallest text is taken; a disputed label counts as toxic. Null ids and labels aren't used. Without
    toxic labels nothing is toxic.
    """
    each = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = {r.doc_id: r.toxic for kind, size in zip((1, 0), sample) for r in each.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()}
    if not chosen:
        return Severity(np.zeros(FEATURES), np.full(GRADES - 1, 40.0), 0.5)
    few = id_text(docs).where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, toxic, order = [], [], []
        for batch in batches:
            for part in blocks.blocks(batch):
                codes, distinct, at = tokens(blocks.texts_of(part.column(1)))
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    code, count = np.unique(codes[at[k] : at[k + 1]], return_counts=True)
                    bags.append([(distinct[c], int(m)) for c, m in zip(code, count)])
                    toxic.append(chosen[doc_id] == 1)
                    order.append(xxhash.xxh64_intdigest(str(doc_id)))
        by = np.argsort(np.array(order, np.uint64), kind="stable")
        model = train([bags[i] for i in by], np.array(toxic, bool)[by])
        some = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([some.tolist()], pa.list_(pa.int64())), pa.array([model.weights[some].tolist()], pa.list_(pa.float64())), pa.array([model.thetas.tolist()], pa.list_(pa.float64())), pa.array([model.cut])], ["at", "weights", "thetas", "cut"])

    row = few.repartition(1).mapInArrow(learn, "at array<long>, weights array<double>, thetas array<double>, cut double").first()
    weights = np.zeros(FEATURES)
    weights[row.at] = row.weights
    return Severity(weights, np.array(row.thetas), row.cut)


def grade_documents(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, n_words, score, p_mild, p_marked, p_severe (of at least that grade), expected_severity (0 to 3), grade and toxic.

    The score sums the weights of all words of the whole text (lower case; a word counts
    at most three times). A null or empty text scores 0; repeated rows are graded alike.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, distinct, at = tokens(blocks.texts_of(batch.column(1)))
        weight = model.words(distinct)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
        heavy = weight[codes] != 0
        pair, count = np.unique(doc[heavy] * max(1, len(distinct)) + codes[heavy], return_counts=True)
        score = np.bincount(pair // max(1, len(distinct)), weight[pair % max(1, len(distinct))] * np.minimum(count, 3), minlength=batch.num_rows).astype(np.float64)
        p = model.above(score)
        toxic = p[:, 0] >= model.cut
        grade = np.where(toxic, np.maximum(1, (p >= 0.5).sum(axis=1)), 0)
        columns = [np.diff(at), np.round(score, 6), *np.round(p, 6).T, np.round(p.sum(axis=1), 6)]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(grade.astype(np.int32)), pa.array(toxic)], ["doc_id", "n_words", "score", "p_mild", "p_marked", "p_severe", "expected_severity", "grade", "toxic"])

    return id_text(docs).mapInArrow(per_block(run), "doc_id long, n_words long, score double, p_mild double, p_marked double, p_severe double, expected_severity double, grade int, toxic boolean")
