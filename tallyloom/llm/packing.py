"""Hierarchical packing of documents into training sequences of several lengths (9)."""

from __future__ import annotations

import bisect
import heapq
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import blocks, bpe
from .common import id_text
from .tokens import cut_out

#: Context sizes; a sequence has one of these lengths, and so needs no padding.
TIERS = (2048, 1024, 512, 256)
#: Tokens of a step group, a whole number of the longest sequences.
STEP_TOKENS = 16 * TIERS[0]

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def text_ids(texts: blocks.Texts, merge: bpe.RankMerger, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts with end_id after each, ragged."""
    pieces, first, special = cut_out(texts, merge.added)
    words = blocks.word_level_tokens(blocks.normalised(pieces))
    codes, distinct = words.encode()
    offsets, data = blocks.parts(distinct)
    values, ends = merge(data, offsets)
    flat, at = blocks.ragged(values, ends, codes)
    at = at[words.docs]  # where each piece begins
    if (special >= 0).any():  # of an added token's string there is its id alone
        kept = np.repeat(special < 0, np.diff(at))
        sizes = np.where(special < 0, np.diff(at), 1)
        whole = np.append(0, np.cumsum(sizes))
        out = np.empty(int(whole[-1]), flat.dtype)
        inside = np.repeat(special < 0, sizes)
        out[inside], out[~inside] = flat[kept], special[special >= 0]
        flat, at = out, whole
    docs = at[first]
    out = np.insert(flat, docs[1:], end_id).astype("<u4")
    return out, docs + np.arange(len(docs))


class Packer:
    """Packs documents, given in groups, into sequences; what doesn't fill one waits for the next group.

    An item is (length, document, start). Documents of a full longest window or more fill
    such windows; the rest, and each shorter document, belongs to the shortest tier that
    holds it. From the longest tier down, each item opens a window of its tier, whose gap
    takes the largest items of shorter tiers that fit, and at last the head of one that
    doesn't. What is left over is strung together and cut.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.waiting: list[tuple[int, int, int]] = []

    def pack(self, items: list[tuple[int, int, int]], last: bool = False) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Windows as (tier, items in them)."""
        top, windows, pool = self.tiers[0], [], []
        for n, doc, start in items:
            while n >= top:
                windows.append((top, [(top, doc, start)]))
                n, start = n - top, start + top
            if n:
                pool.append((n, doc, start))
        pool.sort()
        rest = self.waiting
        for tier in self.tiers:
            half = tier // 2
            while pool and pool[-1][0] > half:
                window = [pool.pop()]
                gap = tier - window[0][0]
                while gap:
                    fits = min(bisect.bisect_right(pool, (gap, float("inf"))), bisect.bisect_right(pool, (half, float("inf"))))
                    if fits:
                        window.append(pool.pop(fits - 1))
                        gap -= window[-1][0]
                        continue
                    shorter = bisect.bisect_right(pool, (half, float("inf")))
                    if not shorter:
                        break
                    n, doc, start = pool.pop(shorter - 1)
                    window.append((gap, doc, start))
                    bisect.insort(pool, (n - gap, doc, start + gap))
                    gap = 0
                if gap:
                    rest.extend(window)
                else:
                    windows.append((tier, window))
        rest.extend(reversed(pool))
        left = sum(x[0] for x in rest)
        rest.reverse()
        for tier in self.tiers:
            while left >= tier:
                windows.append((tier, self._take(rest, tier)))
                left -= tier
        if last and left:
            windows.append((top if left & (left - 1) else left, self._take(rest, left)))
        rest.reverse()
        self.waiting = rest
        return windows

    @staticmethod
    def _take(rest: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
        out = []
        while room:
            n, doc, start = rest.pop()
            if n > room:
                rest.append((n - room, doc, start + room))
                n = room
            out.append((n, doc, start))
            room -= n
        return out


def step_groups(lengths: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window, so that groups hold as equal numbers of tokens as can be: longest first, to the emptiest."""
    heap = [(0, g) for g in range(max(1, -(-sum(lengths) // tokens)))]
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        held, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (held + lengths[k], g))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens; one pass, no shuffle.

    Every task packs its own documents, a block at a time. Only the last sequence of a task
    may be short of a tier's length; it is padded to the longest unless its own length is a power of two.
    sequence_id and step_group are unique over the whole result: the task's number, then a
    count. A null or empty text is the end id alone; repeated rows are packed one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = bpe.merger(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        packer, sequences, groups = Packer(), 0, 0
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        docs_seen = 0

        def rows(windows) -> pa.RecordBatch | None:
            nonlocal sequences, groups
            if not windows:
                return None
            group = step_groups([t for t, _ in windows])
            out: list[list] = [[] for _ in range(9)]
            for (tier, window), g in zip(windows, group):
                at = 0
                for n, doc, start in window:
                    doc_id, ids = held[doc]
                    row = (doc_id, start, n, zlib.crc32(ids[start : start + n]), len(ids), base + sequences, at, tier, base + groups + g)
                    for column, value in zip(out, row):
                        column.append(value)
                    at += n
                sequences += 1
            groups += max(group) + 1
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

        for batch in batches:
            for part in blocks.blocks(batch):
                flat, at = text_ids(blocks.texts_of(part.column(1)), merge, end_id)
                items = []
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    held[docs_seen] = (doc_id, flat[at[k] : at[k + 1]])
                    items.append((int(at[k + 1] - at[k]), docs_seen, 0))
                    docs_seen += 1
                out = rows(packer.pack(items))
                if out:
                    yield out
                held = {d: (held[d][0], held[d][1].copy()) for _, d, _ in packer.waiting}
        out = rows(packer.pack([], last=True))
        if out:
            yield out

    return id_text(docs).mapInArrow(run, SCHEMA)
