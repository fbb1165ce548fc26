import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import blocks, bpe, packing, tokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
texts = st.lists(st.text(alphabet=st.sampled_from("ab'sstmdrevel  \n\t!?-#01é中ñΣİ́ß<|>٣ "), max_size=60), max_size=12)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_pretokens_are_the_matches_of_the_pattern(batch):
    words = blocks.byte_level_tokens(blocks.texts_of(pa.array(batch, pa.string())))
    got = [[words.data[words.offsets[j] : words.offsets[j + 1]].tobytes().decode() for j in range(a, b)] for a, b in zip(words.docs, words.docs[1:])]
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in batch]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_words_are_the_matches_of_their_pattern(batch):
    words = blocks.words(blocks.texts_of(pa.array(batch, pa.string())))
    got = [[words.data[words.offsets[j] : words.offsets[j + 1]].tobytes().decode() for j in range(a, b)] for a, b in zip(words.docs, words.docs[1:])]
    assert got == [regex.findall(r"[^\x20\x09-\x0D]+", t) for t in batch]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_merging_in_step_gives_the_library_s_ids(name):
    rng = random.Random(5)
    batch = ["".join(rng.choice("thandeing 'srevlo\nXé中ñ12#-") for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["a" * 700, "-" * 255, "=" * 5001, "ab" * 3000, " " * 900 + "x", "th" * 333 + "e" * 4000]
    library, merge = Tokenizer.from_file(public_tokenizers.path(name)), bpe.merger(public_tokenizers.path(name))
    given_texts = blocks.texts_of(pa.array(batch))
    words = blocks.byte_level_tokens(given_texts) if "byte" in name else blocks.word_level_tokens(blocks.normalised(given_texts))
    ids, ends = merge(words.data, words.offsets)
    for i, t in enumerate(batch):
        assert ids[ends[words.docs[i]] : ends[words.docs[i + 1]]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_strings_of_added_tokens_are_cut_out(spark):
    """Whole, touching, repeated and broken ones, and halves in neighbouring texts."""
    e = "<|endoftext|>"
    batch = [e, f"a{e}b", f"{e}{e} x {e}", "<|endof", "text|>", f"<|endoftext|{e}>", f" {e} \n", "", f"<|startoftext|>é {e}Σ"]
    docs = spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert [r.n_tokens for r in tokens.count_tokens(docs, path).orderBy("doc_id").collect()] == [len(library.encode(t, add_special_tokens=False).ids) for t in batch]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    flat, at = packing.text_ids(blocks.texts_of(pa.array(batch)), bpe.merger(path), 1)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in batch]


def test_merges_whose_order_matters(tmp_path):
    """A file in which what a merge makes is part of an earlier one: the leftmost place alone is merged at a time."""
    names = bpe.byte_symbols()
    merges = ["x y", "abc d", "a b", "ab c", "b c", "a bc"]
    vocab = {n: i for i, n in enumerate(dict.fromkeys([*names, "xy", "abcd", "ab", "abc", "bc"]))}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"version": "1.0", **spec}))
    merge, library = bpe.RankMerger(str(path)), Tokenizer.from_file(str(path))
    assert not merge.at_once.all()
    rng = random.Random(1)
    for t in ("abcabcd", "abcdabcd", *("".join(rng.choice("abcdxy") for _ in range(40)) for _ in range(50))):
        ids, _ = merge(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert ids.tolist() == library.encode(t).ids


def rows_of(df):
    return df.select("doc_id", "text").collect()


def test_counts(spark, awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = []
    for doc_id, text in rows_of(awkward):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, tokens.count_tokens(awkward, path).collect()), key=key) == sorted(want, key=key)
    assert tokens.count_tokens(empty, path).collect() == []


def test_encoding_and_decoding(spark, awkward, empty):
    encoding, _ = tokens.rank_encoding(RANKS, public_tokenizers.PATTERN)
    want, digests = [], []
    for doc_id, text in rows_of(awkward):
        ids = encoding.encode_ordinary(text or "")
        want.append((doc_id, len(ids), ids, (text or "").encode()))
        digests.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[1])
    got = [(r[0], r[1], list(r[2]), bytes(r[3])) for r in tokens.encode_corpus(awkward, RANKS, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    got = map(tuple, tokens.encode_corpus(awkward, RANKS, public_tokenizers.PATTERN, digest=True).collect())
    assert sorted(got, key=key) == sorted(digests, key=key)
    assert tokens.encode_corpus(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_blocks_of_any_size_encode_alike(spark, awkward, monkeypatch):
    whole = tokens.encode_corpus(awkward, RANKS, public_tokenizers.PATTERN, digest=True).collect()
    monkeypatch.setattr(tokens, "DICTIONARY_BYTES", 3000)
    assert sorted(map(str, whole)) == sorted(map(str, tokens.encode_corpus(awkward, RANKS, public_tokenizers.PATTERN, digest=True).collect()))


def check_packing(rows, want):
    """rows of pieces; want: for each id the ids of its rows."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    short = 0
    for window in sequences.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        short += bool(at & (at - 1))
    assert set(pieces) == set(want)
    for doc_id, copies in want.items():
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, copies))
        for r in pieces[doc_id]:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in copies)
        if len(copies) == 1:
            spans = sorted((r.start, r.length) for r in pieces[doc_id])
            assert [s for s, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1])
    return len(sequences), short


def test_packing(spark, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, want = Tokenizer.from_file(path), defaultdict(list)
    for doc_id, text in rows_of(awkward):
        want[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    for n in (1, 5):
        got = packing.pack_documents(awkward.repartition(n), path).collect()
        count, short = check_packing(got, want)
        assert short <= n  # at most one padded sequence for each task
    assert packing.pack_documents(empty, path).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=60))
def test_packer_places_each_token_once(lengths):
    packer = packing.Packer()
    windows = packer.pack([(n, i, 0) for i, n in enumerate(lengths[:30])]) + packer.pack([(n, i + 30, 0) for i, n in enumerate(lengths[30:])], last=True)
    spans = sorted((doc, start, n) for _, w in windows for n, doc, start in w)
    covered = defaultdict(int)
    for doc, start, n in spans:
        assert covered[doc] == start
        covered[doc] += n
    assert [covered[i] for i in range(len(lengths))] == lengths
    assert all(sum(x[0] for x in w) == tier for tier, w in windows[:-1])
    groups = packing.step_groups([t for t, _ in windows])
    loads = defaultdict(int)
    for (tier, _), g in zip(windows, groups):
        loads[g] += tier
    assert not loads or max(loads.values()) - min(loads.values()) <= 2048
