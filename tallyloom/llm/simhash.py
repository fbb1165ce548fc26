"""SimHash near-duplicates through pivot distance tables (7).

A fingerprint is 64 bits; two link when at most 4 bits differ. Only distinct fingerprints
are compared. They meet in buckets: the 64 bits fall into m groups, four differing bits
leave m - 4 of the groups untouched, so each linked pair shares the bits of one of the
choices of m - 4 groups. There are six groups, and more of them the more fingerprints there are: keys
get wider (21, 27, 32 and 35 bits at least), so that unlike fingerprints seldom meet, at any size. Within a bucket the distances of each fingerprint to the reference fingerprints are
tabulated. By the triangle inequality a pair is at least as far apart as its largest
coordinate difference, so pairs that differ by more than 4 in a coordinate are discarded;
the rest are compared bit by bit.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from . import blocks
from .common import appended, columns_of, discard, fresh, id_text, per_block, written

SHINGLE = 4
SEED = 42
BITS = 4
#: Up to so many fingerprints, the bits are cut into so many groups; every choice finds every link.
SCHEMES = ((1 << 24, 6), (1 << 30, 7), (1 << 35, 8), (1 << 62, 9))
#: Buckets up to this size are paired directly; larger ones are thinned first.
SMALL = 48
#: A larger bucket is split once more, by other bit groups.
LARGE = 4096
#: Rows of a task that are looked at together, and pairs held at once.
ROWS, PAIRS = 1 << 18, 1 << 19


def _references(n: int = 16) -> np.ndarray:
    """The reference fingerprints: words of a fixed pseudo-random sequence, so every task has the same."""
    return np.array([xxhash.xxh64_intdigest(b"reference %d" % i, SEED) for i in range(n)], np.uint64)


REFERENCES = _references()


# --- fingerprints -----------------------------------------------------------------------


def fingerprints_of(texts: blocks.Texts) -> np.ndarray:
    words = blocks.words(texts, lowered=True)
    n = len(words)
    out = np.zeros(len(texts), np.uint64)
    if not n:
        return out
    spaced = np.full(len(words.data) + n, 32, np.uint8)
    spaced[np.arange(len(words.data)) + np.repeat(np.arange(n), np.diff(words.offsets))] = words.data
    begins, ends = words.offsets[:-1] + np.arange(n), words.offsets[1:] + np.arange(n)
    count = np.diff(words.docs)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    first = np.append(0, np.cumsum(shingles))
    doc = np.repeat(np.arange(len(texts)), shingles)
    at = words.docs[doc] + np.arange(first[-1]) - first[doc]
    until = np.minimum(at + SHINGLE, words.docs[doc + 1]) - 1
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begins[at].tolist(), ends[until].tolist())), np.uint64, len(at))
    some = np.flatnonzero(shingles)
    set_bits = np.zeros((len(some), 64), np.int64)
    # documents are taken in runs of bounded length, so that the table of bits stays small
    k = 0
    while k < len(some):
        stop = max(k + 1, int(np.searchsorted(first[some], first[some[k]] + (1 << 18))))
        lo, hi = first[some[k]], first[some[stop - 1] + 1]
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits[k:stop] = np.add.reduceat(bits, first[some[k:stop]] - lo, axis=0, dtype=np.int32)
        k = stop
    majority = 2 * set_bits > shingles[some][:, None]
    out[some] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(blocks.texts_of(batch.column(1))).view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(per_block(run), "doc_id long, fp long")


# --- links -----------------------------------------------------------------------------


def bit_groups(m: int) -> list[tuple[int, int]]:
    """m groups of the 64 bits, as even as can be: shift and width."""
    edges = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def key_choices(m: int) -> list[list[tuple[int, int]]]:
    """Which groups make the bits of each key."""
    return [list(c) for c in combinations(bit_groups(m), m - BITS)]


def groups_for(n: int) -> int:
    return next(m for most, m in SCHEMES if n <= most)


def bucket_keys(fp: Column, m: int = 6) -> Column:
    """The keys of a fingerprint: which groups, and their bits."""
    keys = []
    for k, chosen in enumerate(key_choices(m)):
        key = F.lit(0).cast("long")
        for shift, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1))
        keys.append(key.bitwiseOR(F.lit(k << 48)))
    return F.array(*keys)


def _keys(fp: np.ndarray, k: int) -> np.ndarray:
    key = np.zeros(len(fp), np.uint64)
    for shift, width in key_choices(6)[k]:
        key = key << np.uint64(width) | (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return key


def table(fp: np.ndarray) -> np.ndarray:
    """Distances to the reference fingerprints, by row."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def survivors(fp: np.ndarray, distance: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that link: discarded by coordinates first, then verified."""
    for c in range(0, distance.shape[1], 4):
        near = (np.abs(distance[i, c : c + 4] - distance[j, c : c + 4]) <= BITS).all(axis=1)
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= BITS
    return i[near], j[near]


class Forest:
    """Components of a growing set of links among n items."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        while True:
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            a, b = self.label[a], self.label[b]


def within(fp: np.ndarray, forest: Forest, index: np.ndarray) -> None:
    """Links among fp (distinct), by windows over the first coordinate; index: their numbers in the forest."""
    n = len(fp)
    near = np.bitwise_count(fp ^ fp[0]) <= BITS  # all these link to the first, and need no comparison among themselves
    forest.add(index[near], np.full(int(near.sum()), index[0]))
    rest = np.flatnonzero(~near)
    if not len(rest):
        return
    distance = table(fp)
    order = np.argsort(distance[:, 0], kind="stable")
    ranked = distance[order, 0].astype(np.int64)
    low = np.searchsorted(ranked, distance[rest, 0].astype(np.int64) - BITS, "left")
    high = np.searchsorted(ranked, distance[rest, 0].astype(np.int64) + BITS, "right")
    size = high - low
    k = 0
    while k < len(rest):
        stop = max(k + 1, int(np.searchsorted(np.cumsum(size[k:]), PAIRS, "right")) + k)
        lengths = size[k:stop]
        begin = np.cumsum(lengths) - lengths
        j = order[np.arange(lengths.sum()) - np.repeat(begin - low[k:stop], lengths)]
        i = np.repeat(rest[k:stop], lengths)
        apart = (i < j) | near[j]
        i, j = survivors(fp, distance, i[apart], j[apart])
        forest.add(index[i], index[j])
        k = stop


def large_bucket(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fp (distinct)."""
    forest, every = Forest(len(fp)), np.arange(len(fp))
    if len(fp) <= LARGE:
        within(fp, forest, every)
    else:
        turned = fp << np.uint64(59) | fp >> np.uint64(5)  # other bit groups than those which all of them share
        for k in range(15):
            keys = _keys(turned, k)
            order = np.argsort(keys, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])), len(order))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1 and len(np.unique(forest.label[order[a:b]])) > 1:
                    within(fp[order[a:b]], forest, order[a:b])
    member = np.flatnonzero(forest.label != every)
    return fp[member], fp[forest.label[member]]


def bucket_links(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows that are in order of keys."""
    cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    size = np.diff(cuts)
    left, right = [], []
    for b in np.flatnonzero(size > SMALL):
        a, c = large_bucket(np.unique(fp[cuts[b] : cuts[b + 1]]))
        left.append(a)
        right.append(c)
    few = np.repeat((size > 1) & (size <= SMALL), size)
    keys, fp = keys[few], fp[few]
    if len(fp):
        distance = table(fp)
        i = np.arange(len(fp))
        for step in range(1, SMALL):
            i = i[i + step < len(fp)]
            i = i[keys[i] == keys[i + step]]
            if not len(i):
                break
            a, b = survivors(fp, distance, i, i + step)
            left.append(fp[a])
            right.append(fp[b])
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


def link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (key, fp) in order of key: links (u, v), u > v. A bucket is never cut."""

    def links(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = (x.view(np.int64) for x in bucket_links(keys, fp))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    held_keys, held, n = [], [], 0
    for batch in batches:
        held_keys.append(batch.column(0).to_numpy())
        held.append(batch.column(1).to_numpy().view(np.uint64))
        n += batch.num_rows
        if n < ROWS:
            continue
        keys, fp = np.concatenate(held_keys), np.concatenate(held)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield links(keys[:cut], fp[:cut])
        held_keys, held, n = [keys[cut:]], [fp[cut:]], 0
    if held:
        keys, fp = np.concatenate(held_keys), np.concatenate(held)
        if len(keys):
            yield links(keys, fp)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v), u > v, among distinct fingerprints; enough of them to connect all that link."""
    keyed = distinct.select(F.explode(bucket_keys(F.col("fp"), groups_for(distinct.count()))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link_rows, "u long, v long").distinct()


# --- components ------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node that u, another one, can reach. Alternating large and small stars.

    Neither step gathers a node's neighbours: their smallest is an aggregate, joined back.
    Each round is a written table; the rounds grow as the logarithm of the longest path.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's smaller neighbours, and the node itself, go to the smallest of them
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small)
        discard(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state


def groups(prints: DataFrame) -> DataFrame:
    """fp, root (the fingerprint that names its component) and component_id of each distinct fingerprint. prints: doc_id, fp."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = components(links(distinct.select("fp")))
    nodes = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    named = distinct.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document.

    component_id is the smallest doc_id among all documents that links reach, itself
    included. Texts without words have fingerprint zero, and link like any other. Null ids
    stay; they never become a component_id unless a component has no other. Equal
    fingerprints are one node however many rows hold them. An empty table has an empty result; other columns are not read.
    """
    prints = written(fingerprints(docs))
    return prints.join(groups(prints).drop("root"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of docs, whole, for each component of fingerprints.

    It is that of the smallest id; rows without an id come after all others. Among rows of one id
    the smallest fingerprint, then the smallest hash of the text decides, so rows of one id with unlike texts
    belong to their own components, and none stands for another. Null and empty texts are one component.
    """
    fp, row, digest = fresh(docs.columns, "fp", "row", "digest")
    known = appended(docs, lambda b: [pa.array(fingerprints_of(blocks.texts_of(b.column(1))).view(np.int64))], [StructField(fp, LongType())])
    table = written(known.withColumn(row, F.monotonically_increasing_id()))
    keyed = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col(fp), F.xxhash64("text").alias(digest), F.col(row).alias("row")).alias("key"))
    # the first row of each fingerprint is found before the join, so a fingerprint that many rows hold is one row there
    first = keyed.groupBy("fp").agg(F.min("key").alias("key"))
    chosen = first.join(groups(keyed), "fp").groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.row").alias(row))
    return table.join(chosen, row, "left_semi").select(*columns_of(docs))
