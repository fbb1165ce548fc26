"""Byte-pair merging over ragged numpy arrays, in step for many sequences at once.

All pre-tokens of a batch lie in one flat array of symbols. In each round every sequence
applies its own lowest-rank adjacent pair, at all places where it doesn't overlap itself, from the left. That is
what merging one by one gives as long as every pair that the new symbol can be part of ranks later; where a file
has it otherwise, the leftmost place alone is merged. So a run of n equal bytes takes about log n rounds. A sequence leaves the arrays when
no pair of its symbols can merge.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from . import blocks

NONE = np.int32(2**31 - 1)
#: Pre-tokens that are merged together, and about how many bytes.
CHUNK, CHUNK_BYTES = 1 << 16, 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class RankMerger:
    """Merges of a `tokenizers` BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        tail = len(self.suffix)
        self.merged = np.array([vocab[(a[:-tail] if tail and a.endswith(self.suffix) else a) + b] for a, b in pairs], np.int32)
        names = byte_symbols()
        self.first = np.array([vocab[x] for x in names], np.int32)
        self.last = np.array([vocab[x + self.suffix] for x in names], np.int32)
        #: Strings that are taken out of a text before anything else, and their ids.
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        earliest = np.full(1 << 20, NONE)
        np.minimum.at(earliest, self.keys >> 20, self.ranks)
        np.minimum.at(earliest, self.keys & (1 << 20) - 1, self.ranks)
        #: Of each merge: whether all pairs with what it makes come later.
        self.at_once = earliest[self.merged] > np.arange(len(self.merged))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[offsets[i]:offsets[i+1]], ragged: values and offsets."""
        n = len(offsets) - 1
        pieces, owners, lengths = [], [], []
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")  # chunks of like lengths finish together
        order = order[sizes[order] > 0]
        filled = np.cumsum(sizes[order])
        k = 0
        while k < len(order):
            before = filled[k - 1] if k else 0
            stop = min(k + CHUNK, max(k + 1, int(np.searchsorted(filled, before + CHUNK_BYTES, "right"))))
            self._merge(data, offsets, order[k:stop], pieces, owners, lengths)
            k = stop
        out = np.zeros(n + 1, np.int64)
        if not pieces:
            return np.zeros(0, np.int32), out
        values, owner, length = np.concatenate(pieces), np.concatenate(owners), np.concatenate(lengths)
        begin = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=begin[1:])
        back = np.argsort(owner, kind="stable")
        values, _ = blocks.ragged(values, begin, back)
        counts = np.zeros(n, np.int64)
        counts[owner] = length
        np.cumsum(counts, out=out[1:])
        return values, out

    def _merge(self, data, offsets, chosen, pieces, owners, lengths) -> None:
        raw, starts = blocks.ragged(data, offsets, chosen)
        sym = self.first[raw]
        sym[starts[1:] - 1] = self.last[raw[starts[1:] - 1]]
        size, starts = np.diff(starts), starts[:-1]
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[starts + size - 1] = NONE
        while len(chosen):
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                inside = np.repeat(done, size)
                pieces.append(sym[inside])
                owners.append(chosen[done])
                lengths.append(size[done])
                live = ~inside
                sym, rank = sym[live], rank[live]
                chosen, size, low = chosen[~done], size[~done], low[~done]
                if not len(chosen):
                    return
                starts = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(low, size))
            seq = np.searchsorted(starts, hits, "right") - 1
            fresh = np.ones(len(hits), bool)
            fresh[1:] = seq[1:] != seq[:-1]
            # of places that overlap, every other one from the left; where order matters, the first of the sequence alone
            run = fresh.copy()
            run[1:] |= np.diff(hits) > 1
            begin = np.flatnonzero(run)
            even = (np.arange(len(hits)) - np.repeat(begin, np.diff(np.append(begin, len(hits))))) % 2 == 0
            taken = even & (fresh | self.at_once[low[seq]])
            hits, seq = hits[taken], seq[taken]
            sym[hits] = self.merged[low[seq]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            sym, rank = sym[keep], rank[keep]
            at = hits - np.arange(len(hits))
            size = size - np.bincount(seq, minlength=len(size))
            starts = np.cumsum(size) - size
            first, last = starts[seq], starts[seq] + size[seq] - 1
            rank[at[at == last]] = NONE
            inner = at[at < last]
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
            after = at[at > first]
            rank[after - 1] = self.rank(sym[after - 1], sym[after])


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)
