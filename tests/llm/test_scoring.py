import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyloom.llm import scoring, tokens

ARGS = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def model(seed=3):
    rng = np.random.default_rng(seed)
    return scoring.Model({k: (rng.normal(size=s) * 0.3).astype(np.float64) for k, s in scoring.SHAPES.items()})


def test_gradient():
    rng = np.random.default_rng(1)
    m = model()
    x, y = rng.integers(0, scoring.CLASSES, (3, scoring.CONTEXT)), rng.integers(0, scoring.CLASSES, (3, scoring.CONTEXT))
    real = rng.random((3, scoring.CONTEXT)) < 0.8
    _, g = m.gradient(x, y, real)
    for name, d in g.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in d.shape)
            if name == "E":
                at = (x[0, 5], at[1])
            old = m[name][at]
            m[name][at] = old + 1e-4
            high = m.gradient(x, y, real)[0]
            m[name][at] = old - 1e-4
            low = m.gradient(x, y, real)[0]
            m[name][at] = old
            assert d[at] == pytest.approx((high - low) / 2e-4, abs=2e-5), name


def test_each_token_is_scored_once_from_what_precedes_it():
    m = scoring.Model({k: v.astype(np.float32) for k, v in model().items()})
    rng = np.random.default_rng(2)
    texts = [np.concatenate([[0], rng.integers(1, scoring.CLASSES, n), [0]]) for n in (0, 1, 29, 30, 31, 32, 57, 58, 59, 300)]
    ends = np.append(0, np.cumsum([len(t) for t in texts]))
    got = scoring.sequence_log_p(m, np.concatenate(texts), ends, chunk=3)
    for t, value in zip(texts, got):
        want = 0.0
        for place in range(1, len(t)):
            # its window: the first one that holds it as a target
            turn = max(0, math.ceil((place - scoring.CONTEXT) / scoring.STRIDE))
            begin = turn * scoring.STRIDE
            x = np.zeros((1, scoring.CONTEXT), int)
            x[0, : place - begin] = t[begin:place]
            want += float(m.log_p(m.body(x)[[place - begin - 1]], np.array([t[place]]))[0])
        assert value == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_it_is_a_distribution():
    m = scoring.Model({k: v.astype(np.float32) for k, v in model().items()})
    h = m.body(np.zeros((1, scoring.CONTEXT), int))[:1]
    p = np.exp([m.log_p(h, np.array([c]))[0] for c in range(scoring.CLASSES)])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    counts = np.random.default_rng(3).integers(0, 50, 500).astype(float)
    ids = scoring.Ids(counts, 10, np.arange(500) % 2 == 0)
    for c in range(1, scoring.CLASSES):
        inside = ids.classes == c
        assert not inside.any() or np.exp(ids.log_share[inside]).sum() == pytest.approx(1)


def base_by_hand(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), h, ws in zip(rows, held, words)]


def test_scores(spark, awkward, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (docs, awkward):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        want = sorted(base_by_hand(rows), key=lambda r: (str(r[0]), r[2]))
        got = sorted(map(tuple, scoring.score_documents(frame, *ARGS).collect()), key=lambda r: (str(r[0]), r[2]))
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    assert scoring.score_documents(empty, *ARGS).collect() == []
    lonely = spark.createDataFrame([(i, "only held out") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {r.n_known for r in scoring.score_documents(lonely, *ARGS).collect()} == {0}


def test_blocks_of_any_size_count_alike(spark, awkward, monkeypatch):
    whole = {str(r.doc_id) + str(r.n_tokens): r.base_score for r in scoring.score_documents(awkward, *ARGS).collect()}
    monkeypatch.setattr(tokens, "DICTIONARY_BYTES", 2000)
    monkeypatch.setattr(tokens, "ENCODE_ROWS", 7)
    for r in scoring.score_documents(awkward, *ARGS).collect():
        assert r.base_score == pytest.approx(whole[str(r.doc_id) + str(r.n_tokens)])


def test_training_helps_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = scoring.score_documents(docs, *ARGS).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS a").first().a
    assert held > -4.7  # classes by their shares alone give -5.5


def test_every_training_document_trains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = scoring.score_documents(docs, *ARGS).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS a").first().a
    assert held > -4.42  # a model of one document in 32 gives -4.49


def test_pieces_hold_every_chosen_text_once(monkeypatch):
    monkeypatch.setattr(scoring, "PIECE", 10)
    sizes = [0, 3, 25, 4, 4, 4, 0, 9]
    ends = np.append(0, np.cumsum(sizes))
    which = np.array([0, 2, 3, 4, 5, 6])
    got = [(int(i), ids[a:b].tolist()) for own, ids, at in scoring.pieces(np.arange(ends[-1]), ends, which) for i, a, b in zip(own, at, at[1:])]
    assert got == [(int(i), list(range(ends[i], ends[i + 1]))) for i in which]


def symbols(seed=4, n=500):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 3, n).astype(float) * rng.integers(1, 50, n)
    ids = scoring.Ids(counts, 10, np.arange(n) % 2 == 0, rng.random((n, 6)))
    m = model(seed).with_symbols(ids.symbol_share)
    for k in ("D", "V"):
        m[k] = rng.normal(size=m[k].shape) * 0.3
    m["c"] = m["c"].astype(np.float64)
    return ids, m


def test_gradient_of_symbols():
    ids, m = symbols()
    rng = np.random.default_rng(1)
    x, y = ids.symbols[rng.integers(0, 500, (3, scoring.CONTEXT))], ids.symbols[rng.integers(0, 500, (3, scoring.CONTEXT))]
    real = rng.random(x.shape) < 0.8
    _, g = m.gradient(x, y, real, ids.cuts)
    row = int(x[x > scoring.SINGLES][0]) - scoring.SINGLES - 1
    for name, d in g.items():
        for k in range(4):
            at = tuple(rng.integers(0, n) for n in d.shape)
            at = (row, k) if name == "D" else (int(scoring.classes_of(x, ids.cuts)[0, k]), k) if name == "E" else at
            old = m[name][at]
            m[name][at] = old + 1e-4
            high = m.gradient(x, y, real, ids.cuts)[0]
            m[name][at] = old - 1e-4
            low = m.gradient(x, y, real, ids.cuts)[0]
            m[name][at] = old
            assert d[at] == pytest.approx((high - low) / 2e-4, abs=2e-5), name


def test_ids_of_one_class_are_told_apart():
    ids, m = symbols()
    m = scoring.Model.unpack(scoring.Model(m).pack())
    one = lambda *t: float(scoring.sequence_log_p(m, ids.symbols[np.array(t)] * (np.array(t) >= 0), np.array([0, len(t)]), cuts=ids.cuts)[0] + ids.log_part[np.array(t)[1:-1]].sum())
    start = int(ids.singles[0])
    every = [one(start, i, start) for i in range(500)]
    shared = next(np.flatnonzero((ids.classes == c) & (ids.symbols != 0)) for c in range(scoring.SINGLES + 1, scoring.CLASSES) if (ids.classes == c).sum() > 3)
    a, b = [int(i) for i in shared if i in np.flatnonzero(ids.log_part == 0)][:2]
    assert one(start, a, start, b, start) != pytest.approx(one(start, b, start, a, start), abs=1e-6)
    # the probabilities of all ids after a start
    h = m.body(np.full((1, scoring.CONTEXT), int(ids.symbols[start])), None, m.inputs(ids.cuts))[:1].repeat(500, axis=0)
    y = ids.symbols
    p = np.exp(m.log_p(h, scoring.classes_of(y, ids.cuts)) + m.within(h, y, ids.cuts) + ids.log_part)
    rest = np.exp(m.log_p(h[:1], np.array([0])))[0]
    gone = [c for c in range(1, scoring.CLASSES) if not (ids.classes == c).any()]
    rest += sum(np.exp(m.log_p(h[:1], np.array([c])))[0] for c in gone)
    assert len(every) == 500 and p.sum() + rest == pytest.approx(1, abs=1e-3)


def test_windows_overlap_by_half():
    assert scoring.CONTEXT - scoring.STRIDE >= scoring.CONTEXT / 2


def test_score_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = scoring.score_documents(docs, *ARGS).where("held_out").selectExpr("sum(score) AS a", "sum(base_score) AS b").first()
    assert r.a > r.b


def test_later_positions_cost_no_exponentials(monkeypatch):
    done = []
    exp = np.exp
    monkeypatch.setattr(scoring.np, "exp", lambda x, **more: (done.append(x.size), exp(x, **more))[1])
    for start in (0, scoring.CONTEXT - scoring.STRIDE):
        done.clear()
        model().body(np.zeros((2, scoring.CONTEXT), int), start=start)
        # half of what a full square of positions would take, and a half span
        assert sum(done) <= 2 * (scoring.CONTEXT - start) * (scoring.CONTEXT + start + scoring.SPAN) / 2


def test_large_weights_stay_finite():
    ids, m = symbols()
    for k in ("U", "V", "QKV"):
        m[k] = m[k] * 300
    x = ids.symbols[np.random.default_rng(5).integers(0, 500, (2, scoring.CONTEXT))]
    h = m.body(x, None, m.inputs(ids.cuts))
    assert not scoring.bounded(h, m["U"], m["b"]) and not scoring.bounded(h, m["V"], m["c"])
    loss, g = m.gradient(x, x, np.ones(x.shape, bool), ids.cuts)
    assert math.isfinite(loss) and all(np.isfinite(d).all() for d in g.values())
    assert np.isfinite(m.log_p(h, scoring.classes_of(x.ravel(), ids.cuts))).all() and (m.within(h, x.ravel(), ids.cuts) <= 1e-9).all()


def test_ids_within_classes_are_scored_for_all_chunks_together(monkeypatch):
    ids, m = symbols()
    rng = np.random.default_rng(6)
    texts = [np.concatenate([[0], ids.symbols[rng.integers(0, 500, n)], [0]]) for n in (5, 64, 200, 700)]
    args = m, np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
    want = scoring.sequence_log_p(*args, chunk=1000, cuts=ids.cuts)
    done = []
    within = scoring.Model.within
    monkeypatch.setattr(scoring.Model, "within", lambda *a, **more: (done.append(len(a[2])), within(*a, **more))[1])
    assert scoring.sequence_log_p(*args, chunk=2, cuts=ids.cuts) == pytest.approx(want)
    assert len(done) == 1


def test_ids_within_classes_whose_exponentials_leave_the_range():
    ids, m = symbols()
    m = scoring.Model({k: v.astype(np.float32) for k, v in m.items()})
    m["V"] *= 400
    h = np.random.default_rng(7).normal(size=(500, scoring.DIM)).astype(np.float32)
    got = m.within(h, ids.symbols, ids.cuts)
    for i in range(500):
        y = int(ids.symbols[i]) - scoring.SINGLES - 1
        if y >= 0:
            c = np.searchsorted(ids.cuts, y, "right") - 1
            z = m["V"][ids.cuts[c] : ids.cuts[c + 1]].astype(float) @ h[i] + m["c"][ids.cuts[c] : ids.cuts[c + 1]]
            assert got[i] == pytest.approx(z[y - ids.cuts[c]] - np.logaddexp.reduce(z), rel=1e-4, abs=2e-3)
        else:
            assert got[i] == 0


def test_a_step_goes_over_one_vector_of_weights():
    ids, m = symbols()
    m = scoring.Model({k: v.astype(np.float32) for k, v in m.items()})
    before = {k: v.copy() for k, v in m.items()}
    seq = np.concatenate([[0], ids.symbols[np.random.default_rng(8).integers(0, 500, 300)], [0]])
    got = scoring.train_local(m, seq, np.array([0, len(seq)]), 0.01, 1, {}, ids.cuts)
    assert len({id(v if v.base is None else v.base) for v in got.values()}) == 1
    # Adam's first step moves a weight by the rate, against its gradient's sign
    x, y, real, _ = scoring.windows(seq, np.array([0, len(seq)]), scoring.CONTEXT)
    _, g = scoring.Model(before).gradient(x, y, real, ids.cuts)
    for k, d in g.items():
        clear = np.abs(d) > 1e-5
        assert (got[k] - before[k])[clear] == pytest.approx(-0.01 * np.sign(d[clear]), abs=2e-4), k


def test_each_word_of_a_block_lies_in_one_bucket():
    words = sorted({"a", "b" * 70, "b" * 71, "é", "zwölf", *(f"w{i}" for i in range(300))})
    data, ends = np.frombuffer("".join(words).encode(), np.uint8), np.append(0, np.cumsum([len(w.encode()) for w in words]))
    n = np.arange(len(words))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), *(pa.array([x, y], pa.binary()) for x, y in ((data.tobytes(), b""), (ends.astype("<i8").tobytes(), np.zeros(1, "<i8").tobytes()), (n.astype("<i8").tobytes(), b"")))], ["block", "words", "word_ends", "n"])
    got, found = list(scoring.in_buckets(5)(iter([batch]))), {}
    for bucket, block, raw, sizes, slots, counts in (r for b in got for r in zip(*(c.to_pylist() for c in b.columns))):
        at = np.append(0, np.cumsum(np.frombuffer(sizes, "<i4")))
        for i, (slot, c) in enumerate(zip(np.frombuffer(slots, "<i4"), np.frombuffer(counts, "<i8"))):
            assert block == 7 and raw[at[i] : at[i + 1]].decode() == words[slot] and c == n[slot] and slot not in found
            found[int(slot)] = bucket
    assert len(found) == len(words) and len(set(found.values())) == 5
    # the bucket depends on the word alone
    alone = {w: int(scoring.buckets_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), 5)[0]) for w in words}
    assert all(alone[words[k]] == b for k, b in found.items())


def test_input_is_read_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = scoring.score_documents(docs.select("doc_id", "text").mapInArrow(seen, "doc_id long, text string"), *ARGS).collect()
    assert read.value == len(rows) == docs.count()


def test_pairs_of_several_kinds_are_counted_in_one_pass(spark):
    texts = [[3, 1, 1], [], [2], [0, 3]]
    ends = np.append(0, np.cumsum([len(t) for t in texts])).astype("<i8")
    packed = bytearray(tokens.pack_codes(np.array(sum(texts, []))))
    frame = spark.createDataFrame([(packed, bytearray(ends.tobytes()))] * 2, "ids binary, ends binary")
    one, two = np.array([1, 2, 2, 3]), np.array([1, 1, 2, 2])
    got = scoring.pair_counts(frame, (one, two), (two, two))
    for found, (left, right) in zip(got, ((one, two), (two, two)), strict=True):
        want = Counter()
        for t in texts:
            want.update(zip([0, *left[t]], [*right[t], 0]))
        assert {(i, j): int(n) for (i, j), n in np.ndenumerate(found) if n} == {k: 2 * n for k, n in want.items()}


def test_products_in_spans():
    rng = np.random.default_rng(9)
    for n in (0, 1, scoring.CONTEXT, 5 * scoring.CONTEXT, 5 * scoring.CONTEXT + 1):
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(n, 4))
        assert scoring.gram(a, b) == pytest.approx(a.T @ b)
