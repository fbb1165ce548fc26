"""Byte-level BPE over whole corpora: encoding and decoding (4) and token counts (5)."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from . import blocks, bpe
from .common import id_text, per_block

#: Texts whose distinct words are told apart together; more bytes, fewer word rows to shuffle.
DICTIONARY_BYTES = 32 << 20
#: Word rows that an encoding task holds before it writes them out by block.
ENCODE_ROWS = 1 << 18


# --- token counts -------------------------------------------------------------------


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of each whole text by rank-synchronous merging, without a shuffle.

    Each block's pre-tokens are found by array operations; its distinct ones are merged in
    step (`bpe.RankMerger`), and a text's count is the sum over its pre-tokens. Strings of added tokens are cut out of
    the texts first, and count 1 each.
    Null and empty texts have 0 tokens; repeated rows and null ids stay as they are.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        merge = bpe.merger(tokenizer_path)
        texts = blocks.texts_of(batch.column(1))
        pieces, first, special = cut_out(texts, merge.added)
        words = blocks.byte_level_tokens(pieces)
        codes, distinct = words.encode()
        offsets, data = blocks.parts(distinct)
        _, ends = merge(data, offsets)
        each = blocks.row_sums(np.diff(ends)[codes], words.docs).astype(np.int64)
        each[special >= 0] = 1
        total = blocks.row_sums(each, first).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(texts.offsets)), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs).mapInArrow(per_block(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def cut_out(texts: blocks.Texts, added: dict[bytes, int]) -> tuple[blocks.Texts, np.ndarray, np.ndarray]:
    """Texts cut before and after each of these strings: the pieces, each text's first piece (and the end), and for each piece the string's id, else -1.

    Strings are found from the left, the longest of those that begin at one place; none reaches over the end of a text.
    """
    whole, spans, at = texts.data.tobytes(), [], 0
    pattern = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    while pattern is not None and (m := pattern.search(whole, at)):
        end = int(texts.offsets[np.searchsorted(texts.offsets, m.start(), "right")])
        if m.end() <= end:
            spans.append((m.start(), m.end(), added[m.group()]))
            at = m.end()
        else:
            at = m.start() + 1
    if not spans:
        return texts, np.arange(len(texts) + 1), np.full(len(texts), -1)
    starts, ends, ids = (np.array(x, np.int64) for x in zip(*spans))
    doc = np.searchsorted(texts.offsets, starts, "right") - 1
    # a text with k strings has 2 k + 1 pieces
    pieces = 1 + 2 * np.bincount(doc, minlength=len(texts))
    first = np.append(0, np.cumsum(pieces))
    turn = np.arange(len(spans)) - np.searchsorted(doc, doc)
    offsets = np.empty(first[-1] + 1, np.int64)
    offsets[first[:-1]], offsets[-1] = texts.offsets[:-1], texts.offsets[-1]
    offsets[first[doc] + 2 * turn + 1], offsets[first[doc] + 2 * turn + 2] = starts, ends
    special = np.full(int(first[-1]), -1)
    special[first[doc] + 2 * turn + 1] = ids
    return blocks.Texts(texts.data, offsets), first, special


# --- encoding and decoding ------------------------------------------------------------


@lru_cache(maxsize=2)
def rank_encoding(path: str, pattern: str):
    """The library's encoding, and the token-byte table."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes as four byte planes, compressed; frequent words have small codes, so upper planes are nearly empty."""
    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack_codes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Block:
    """Some texts as codes into the list of their distinct words, the frequent ones first.

    The key is a hash of the texts' bytes, so that both passes over a table name a block
    alike, and a block that a pass saw otherwise can't be mistaken for it.
    """

    def __init__(self, batch: pa.RecordBatch, tokens):
        texts = blocks.texts_of(batch.column(1))
        self.key = np.int64(np.uint64(xxhash.xxh64_intdigest(texts.data.tobytes() + texts.offsets.tobytes())).view(np.int64))
        pieces, docs, at = [], [np.zeros(1, np.int64)], 0
        for part in blocks.blocks(batch):
            words = tokens(blocks.texts_of(part.column(1)))
            pieces.append(pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(words.offsets.astype(np.int32)), pa.py_buffer(words.data)]))
            docs.append(words.docs[1:] + at)
            at += len(words)
        coded = pa.chunked_array(pieces, pa.binary()).dictionary_encode()
        codes = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks)])
        distinct = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.binary())
        self.counts = np.bincount(codes, minlength=len(distinct)).astype(np.int64)
        order = np.argsort(-self.counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes, self.docs, self.words = rank[codes], np.concatenate(docs), distinct.take(pa.array(order))
        self.counts = self.counts[order]

    def word_rows(self) -> pa.RecordBatch:
        n = len(self.words)
        return pa.RecordBatch.from_arrays([self.words, pa.array(np.full(n, self.key)), pa.array(np.arange(n, dtype=np.int32))], ["word", "block", "slot"])

    def text_rows(self, ids: pa.Array, step: int = 2048) -> pa.RecordBatch:
        rows = range(0, len(ids), step)
        cut = [self.docs[k : k + step + 1] for k in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(cut), self.key)),
                pa.array([ids[k : k + step].to_pylist() for k in rows], pa.list_(pa.int64())),
                pa.array([np.diff(c).astype("<i4").tobytes() for c in cut], pa.binary()),
                pa.array([pack_codes(self.codes[c[0] : c[-1]]) for c in cut], pa.binary()),
            ],
            ["block", "doc_ids", "sizes", "codes"],
        )


def by_block(rows: pa.Table, *, ids: str = "ids") -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of the packed answers to a block's words: ids, ragged by slot."""
    slots = np.frombuffer(b"".join(rows["slots"].to_pylist()), "<i4")
    sizes = np.frombuffer(b"".join(rows["sizes"].to_pylist()), "<i4")
    values = np.frombuffer(b"".join(rows[ids].to_pylist()), "<u4")
    begin = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    n = int(slots.max()) + 1 if len(slots) else 0
    where = np.full(n, -1, np.int64)
    where[slots] = np.arange(len(slots))  # equal blocks have equal answers: either will do
    if (where < 0).any():
        raise ValueError("a block's words are incomplete")
    values, offsets = blocks.ragged(values, begin, where)
    return values, offsets, {"where": where}


def encode_words(path: str, pattern: str):
    """For mapInArrow over word rows in order of words: each distinct word is encoded once, answers go by block."""

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        encoding, _ = rank_encoding(path, pattern)
        coded = rows["word"].chunk(0).dictionary_encode()
        words = [w.decode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
        ids = [encoding.encode_ordinary(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        block, slot = rows["block"].to_numpy(), rows["slot"].to_numpy()
        order = np.argsort(block, kind="stable")
        code = coded.indices.to_numpy(zero_copy_only=False)[order]
        block, slot = block[order], slot[order].astype("<i4")
        values, ends = blocks.ragged(flat, offsets, code)
        cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block[cuts[:-1]]),
                pa.array([slot[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([np.diff(ends[a : b + 1]).astype("<i4").tobytes() for a, b in spans], pa.binary()),
                pa.array([values[ends[a] : ends[b]].astype("<u4").tobytes() for a, b in spans], pa.binary()),
            ],
            ["block", "slots", "sizes", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ENCODE_ROWS:
                yield answer(held)
                held, n = [], 0
        if n:
            yield answer(held)

    return run


def encode_corpus(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """Ids of every text, and the bytes they decode to.

    Every block of texts sends each of its distinct pre-tokens once into a shuffle by word.
    There each distinct word is encoded once, and its ids go back to the blocks that hold
    it. The blocks' texts travel as compressed codes, and a text's ids are put together by
    position. Decoding joins the ids to the token-byte table. Neither text nor
    occurrences of words are shuffled, so a hot word has one row for each block.

    Returns doc_id, n_tokens, ids array<int>, decoded binary; with `digest` their SHA-256
    instead (ids as little-endian unsigned 32-bit integers). A null or empty text has no ids
    and decodes to nothing; repeated rows and null ids stay.
    """
    source = id_text(docs)

    def word_rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        return Block(batch, blocks.byte_level_tokens).word_rows()

    def text_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return Block(batch, blocks.byte_level_tokens).text_rows(batch.column(0))

    words = source.mapInArrow(per_block(word_rows, DICTIONARY_BYTES), "word binary, block long, slot int")
    answers = words.repartition("word").sortWithinPartitions("word").mapInArrow(encode_words(path, pattern), "block long, slots binary, sizes binary, ids binary")
    texts = source.mapInArrow(per_block(text_rows, DICTIONARY_BYTES), "block long, doc_ids array<long>, sizes binary, codes binary")

    def put_together(texts: pa.Table, answers: pa.Table) -> pa.Table:
        _, table = rank_encoding(path, pattern)
        values, offsets, _ = by_block(answers)
        doc_ids, counts, first, second = [], [], [], []
        for row in texts.to_pylist():
            codes = unpack_codes(row["codes"])
            if len(codes) and int(codes.max()) >= len(offsets) - 1:
                raise ValueError("a block's words are incomplete")
            ids, ends = blocks.ragged(values, offsets, codes)
            docs = np.append(0, np.cumsum(np.frombuffer(row["sizes"], "<i4")))
            at = ends[docs]
            raw = memoryview(ids.astype("<u4").tobytes())
            for k, doc in enumerate(row["doc_ids"]):
                a, b = int(at[k]), int(at[k + 1])
                decoded = b"".join(map(table.__getitem__, ids[a:b].tolist()))
                doc_ids.append(doc)
                counts.append(b - a)
                first.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() if digest else ids[a:b].astype(np.int32))
                second.append(hashlib.sha256(decoded).hexdigest() if digest else decoded)
        kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), names[0]: pa.array(first, kinds[0]), names[1]: pa.array(second, kinds[1])})

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    kinds = ("string", "string") if digest else ("array<int>", "binary")
    schema = f"doc_id long, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put_together, schema)
