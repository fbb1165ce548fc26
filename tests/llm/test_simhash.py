import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tallyloom.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """For each fingerprint a representative of its component."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 4:
                parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = brute_components(prints)
    low = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            low[root[p]].append(i)
    return sorted(((str(i), f"{p:016x}", min(low[root[p]], default=None)) for (i, _), p in zip(rows, prints)), key=str)


def test_near_duplicates(spark, awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    got = sorted(((str(r[0]), r[1], r[2]) for r in simhash.near_duplicates(awkward).collect()), key=str)
    assert got == brute(rows)
    assert simhash.near_duplicates(empty).collect() == []


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((str(r[0]), r[1], r[2]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def families(rng, n):
    """Fingerprints that lie close to each other in chains and in balls, and some far from all."""
    out = []
    while len(out) < n:
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 60))):
            out.append(x)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
    return np.array(sorted(set(out)), np.uint64)


@pytest.mark.parametrize("small, large, m", [(48, 4096, 6), (3, 4096, 7), (3, 10, 6), (48, 4096, 8), (48, 4096, 9)])
def test_links_and_components(spark, monkeypatch, small, large, m):
    monkeypatch.setattr(simhash, "SCHEMES", ((1 << 62, m),))
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    fp = families(np.random.default_rng(7), 600)
    for part in (fp, fp & np.uint64(0xFFFFF00000000000 | 0xFFFF)):  # the second: many share buckets
        part = np.unique(part)
        df = spark.createDataFrame([(int(x),) for x in part.view(np.int64)], "fp long")
        got = {r.u & (2**64 - 1): r.v & (2**64 - 1) for r in simhash.components(simhash.links(df)).collect()}
        root = brute_components(part.tolist())
        groups = defaultdict(set)
        for p, r in root.items():
            groups[r].add(p)
        mine = defaultdict(set)
        for p in part.tolist():
            mine[got.get(p, p)].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 999)], "u long, v long")
    assert {r.u: r.v for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 301)}, 1000: 999}
    assert simhash.components(edges.limit(0)).collect() == []
