"""Array views of text columns, shared by the operators of this subpackage.

Arrow hands a Python worker a batch of texts as one byte buffer with offsets. Everything
here works on that buffer with numpy: whitespace words, the pre-tokens of the two public
BPE patterns, and the distinct words of a block. No text is cut, and nothing crosses a
document boundary. A null text is the empty text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one block hold about this many bytes; a longer single text is a block by itself.
BLOCK_BYTES = 4 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACE, BLANK, LETTER, NUMBER, OTHER = range(5)


@dataclass
class Texts:
    """The bytes of some texts, one after another; text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of texts without what lies between them; docs: for each text its first word; at: where each begins in the texts' data."""

    data: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray
    at: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """Codes of the words, and the distinct words in order of their first appearance."""
        return encode(self.data, self.offsets)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    array = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and data of a string or binary array without nulls."""
    wide = np.int64 if array.type in (pa.large_string(), pa.large_binary()) else np.int32
    if len(array) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets, data = parts(column)
    return Texts(data, offsets)


def blocks(batch: pa.RecordBatch, name: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold about `size` bytes."""
    offsets = texts_of(batch.column(batch.schema.get_field_index(name))).offsets
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    return _LOWER[data]


def words(texts: Texts, lowered: bool = False) -> Words:
    r"""Matches of [^\x20\x09-\x0D]+; such a byte never lies inside a longer UTF-8 sequence."""
    data = texts.data
    inside = ~_WS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]]
    begins[firsts] = inside[firsts]
    kept = data[inside]
    starts = np.flatnonzero(begins[inside])
    offsets = np.empty(len(starts) + 1, np.int64)
    offsets[:-1], offsets[-1] = starts, len(kept)
    at = np.flatnonzero(begins)
    return Words(lower(kept) if lowered else kept, offsets, np.searchsorted(at, texts.offsets), at)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """By code point: space, other white space, letter, number, anything else; as the regex patterns see them."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + (0x800 if x >= 0xD800 else 0) for x in m.span())
            table[a:b] = kind
    table[0x20] = SPACE
    return table


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte at which each begins (and the end), and for each text its first code point."""
    data = texts.data
    if not (data > 127).any():
        return data.astype(np.uint32), np.arange(len(data) + 1), texts.offsets
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.append(lead, len(data))
    return points, at, np.searchsorted(at, texts.offsets)


def _contractions(points: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> None:
    """Moves token starts for 's 't 'm 'd 're 've 'll; an apostrophe that begins a token counts."""
    quotes = np.flatnonzero((points == 0x27) & starts)
    if not len(quotes):
        return
    room = docs[np.searchsorted(docs, quotes, "right")] - quotes
    padded = np.append(points, [0, 0, 0])
    one, two = padded[quotes + 1], padded[quotes + 2]
    short = (room > 1) & np.isin(one, [ord(x) for x in "stmd"])
    long = (room > 2) & (((np.isin(one, [ord(x) for x in "rv"])) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for hit, length in ((short, 2), (long, 3)):
        at = quotes[hit]
        starts[at + 1] = False
        follows = at + length
        inner = follows[room[hit] > length]
        starts[inner] = True


def byte_level_tokens(texts: Texts) -> Words:
    """Pre-tokens of the byte-level BPE pattern. They tile each text."""
    points, at, docs = code_points(texts)
    n = len(points)
    if not n:
        return Words(texts.data, np.zeros(1, np.int64), np.zeros(len(docs), np.int64))
    kinds = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[docs] = True
    solid = kinds >= LETTER
    starts = first[:n].copy()
    before, here = kinds[:-1], kinds[1:]
    changes = here != before
    # a solid character begins a token where its class changes, unless a space before it joins it
    starts[1:] |= solid[1:] & changes & (before != SPACE)
    # white space begins a token after something solid, and where a run's last one precedes something solid
    starts[1:] |= ~solid[1:] & solid[:-1]
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = ~solid[:-1] & solid[1:] & ~first[1:n]
    starts |= ends_run
    # across a boundary nothing is joined
    cut = docs[:-1][docs[:-1] < docs[1:]]
    starts[cut] = True
    _contractions(points, starts, docs)
    where = np.flatnonzero(starts)
    return Words(texts.data, np.append(at[where], at[-1]), np.searchsorted(where, docs))


def word_level_tokens(texts: Texts) -> Words:
    """Pre-tokens of the lower-case pattern with single digits; texts are already normalised. White space goes."""
    points, at, docs = code_points(texts)
    n = len(points)
    if not n:
        return Words(texts.data, np.zeros(1, np.int64), np.zeros(len(docs), np.int64))
    kinds = char_classes()[points]
    solid = kinds >= LETTER
    starts = solid.copy()
    starts[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    cut = docs[:-1][docs[:-1] < docs[1:]]
    starts[cut] = solid[cut]
    _contractions(points, starts, docs)
    starts &= solid  # white space after a contraction begins nothing
    lengths = np.diff(at)
    inside = np.repeat(solid, lengths)
    where = np.flatnonzero(starts)
    filled = np.zeros(n + 1, np.int64)
    np.cumsum(np.where(solid, lengths, 0), out=filled[1:])
    return Words(texts.data[inside], np.append(filled[where], filled[-1]), np.searchsorted(where, docs))


def normalised(texts: Texts) -> Texts:
    """NFC, then each character in lower case by itself (a final sigma isn't special)."""
    if not (texts.data > 127).any():
        return Texts(lower(texts.data), texts.offsets)
    out = []
    for i in range(len(texts)):
        raw = texts.text(i)
        if raw.isascii():
            out.append(raw.lower())
        else:
            s = unicodedata.normalize("NFC", raw.decode("utf-8", "surrogatepass"))
            out.append(s.replace("Σ", "σ").lower().encode("utf-8", "surrogatepass"))
    offsets = np.zeros(len(out) + 1, np.int64)
    np.cumsum([len(x) for x in out], out=offsets[1:])
    return Texts(np.frombuffer(b"".join(out), np.uint8), offsets)


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows pick of a ragged array, one after another; and where each begins (and the end)."""
    lengths = np.diff(offsets)[pick]
    out = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    index = np.arange(out[-1])
    index += np.repeat(offsets[:-1][pick] - out[:-1], lengths)
    return values[index], out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values by row; 0 for an empty row."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
