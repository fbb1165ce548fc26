"""Telephony audio: mu-law, A-law and ADPCM decoding, and resampled PCM (1).

Companded samples are expanded through tables of 256 values. ADPCM is sequential within a
block and independent between blocks, so step k is decoded for all blocks of a batch at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import id_text, per_block

RATE = 8000
MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1
#: Bytes of an ADPCM block: a header of 4, then two samples a byte.
BLOCK = 192
SAMPLES = 1 + 2 * (BLOCK - 4)

STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    step, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(step == 0, low + 8, low + 0x108 << np.maximum(step - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def _adpcm() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * step index + code: the change of the sample, and 16 * the next step index."""
    code, step = np.arange(16)[None, :], STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + _MOVES[code], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (16 * following).astype(np.int32).ravel()


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()
CHANGE, FOLLOWING = _adpcm()


def decode_adpcm(raw: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples of the blocks, one row a block. raw: whole blocks, one after another. A step index in a header above 88 counts as 88."""
    rows = raw.reshape(-1, block)
    head = rows[:, :4].astype(np.int32)
    sample = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
    index = 16 * np.minimum(head[:, 2], len(STEPS) - 1)
    body = np.ascontiguousarray(rows[:, 4:].T).astype(np.int32)
    out = np.empty((1 + 2 * len(body), len(rows)), np.int16)
    out[0] = sample
    for k, column in enumerate(body):
        for half, code in enumerate((column & 15, column >> 4)):
            code += index
            sample = sample + CHANGE[code]
            np.clip(sample, -32768, 32767, out=sample)
            index = FOLLOWING[code]
            out[1 + 2 * k + half] = sample
    return np.ascontiguousarray(out.T)


def doubled(samples: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then a value between it and the next by a six-tap half-band filter; ends are repeated, recordings don't mix."""
    n = len(samples)
    out = np.empty(2 * n, np.int16)
    if not n:
        return out
    taps = ((-2, 3), (-1, -25), (0, 150), (1, 150), (2, -25), (3, 3))
    wide = np.concatenate([np.zeros(2, np.int32), samples.astype(np.int32), np.zeros(3, np.int32)])
    between = sum(t * wide[2 + k : 2 + k + n] for k, t in taps)
    lengths = np.diff(offsets)
    first, last = offsets[:-1][lengths > 0], offsets[1:][lengths > 0] - 1
    edges = np.concatenate([np.minimum(first + k, last) for k in range(2)] + [np.maximum(last - k, first) for k in range(3)])
    low, high = np.tile(first, 5), np.tile(last, 5)
    between[edges] = sum(t * samples[np.clip(edges + k, low, high)].astype(np.int32) for k, t in taps)
    out[0::2] = samples
    out[1::2] = np.clip((between + 128) >> 8, -32768, 32767)
    return out


# --- files -----------------------------------------------------------------------------


def wav(kind: int, raw: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel. Companded forms have 8 bits a sample, ADPCM 4 in blocks, PCM 16."""
    bits, align = {MULAW: (8, 1), ALAW: (8, 1), ADPCM: (4, BLOCK), PCM: (16, 2)}[kind]
    speed = rate * BLOCK // SAMPLES if kind == ADPCM else rate * align
    more = struct.pack("<HH", 2, SAMPLES) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, speed, align, bits) + more
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if kind != PCM:
        chunks += b"fact" + struct.pack("<II", 4, len(raw) // BLOCK * SAMPLES if kind == ADPCM else len(raw))
    chunks += b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[int, int, bytes] | None:
    """Format, rate and data; None if it isn't such a file."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return (kind, rate, media[at + 8 : at + 8 + size]) if kind else None
        at += 8 + size + (size & 1)
    return None


def expand(kind: int, raw: bytes) -> np.ndarray:
    """Linear 16-bit samples. What is left of an incomplete last block or sample is dropped."""
    data = np.frombuffer(raw, np.uint8)
    if kind == MULAW:
        return MULAW_TABLE[data]
    if kind == ALAW:
        return ALAW_TABLE[data]
    if kind == ADPCM:
        return decode_adpcm(data[: len(data) // BLOCK * BLOCK]).ravel()
    return data[: len(data) // 2 * 2].view("<i2")


def to_pcm(media: DataFrame, key: str, column: str) -> DataFrame:
    """key, pcm (a WAV file of 16-bit samples at twice the rate), samples and rate of a column of
    mu-law, A-law, ADPCM or PCM WAV files. Null, broken and other files give nulls."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [read_wav(x) if x is not None else None for x in batch.column(1).to_pylist()]
        found = [f if f and f[0] in (MULAW, ALAW, ADPCM, PCM) else None for f in found]
        linear = [expand(f[0], f[2]) if f else np.zeros(0, np.int16) for f in found]
        offsets = np.append(0, np.cumsum([len(x) for x in linear]))
        raw = doubled(np.concatenate([*linear, np.zeros(0, np.int16)]), offsets)
        files = [wav(PCM, raw[2 * a : 2 * b].astype("<i2").tobytes(), 2 * f[1]) if f else None for f, a, b in zip(found, offsets, offsets[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary()), pa.array([2 * len(x) if f else None for f, x in zip(found, linear)], pa.int64()), pa.array([2 * f[1] if f else None for f in found], pa.int32())], [key, "pcm", "samples", "rate"])

    def bounded(batches):
        for batch in batches:
            for part in blocks.blocks(batch, column):
                yield run(part)

    kind = dict(media.dtypes)[key]
    return media.select(key, F.col(column).cast("binary").alias(column)).mapInArrow(bounded, f"`{key}` {kind}, pcm binary, samples long, rate int")


# --- texts as payloads ------------------------------------------------------------------


def payloads(texts: blocks.Texts, unit: int = BLOCK) -> blocks.Texts:
    """Each text with bytes 32 up to a positive multiple of unit."""
    lengths = np.diff(texts.offsets)
    padded = np.maximum(-(-lengths // unit), 1) * unit
    offsets = np.append(0, np.cumsum(padded))
    data = np.full(int(offsets[-1]), 32, np.uint8)
    data[np.arange(len(texts.data)) + np.repeat(offsets[:-1] - texts.offsets[:-1], lengths)] = texts.data
    return blocks.Texts(data, offsets)


def _loudness(samples: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    square = samples.astype(np.int64) ** 2
    return np.add.reduceat(square, offsets[:-1]) // np.diff(offsets)


def digest_payloads(docs: DataFrame) -> DataFrame:
    """Stores every text as a mu-law file, reads it back, decodes it three ways and digests the results.

    feature: mean squares of the samples as mu-law, A-law and ADPCM, sign changes of the
    first, and the CRC-32 of the PCM at twice the rate; all of it exact integers, so equal texts have equal
    features. A null text is the empty one, whose payload is 192 spaces. pcm_sha256 is
    that of the resampled PCM file.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = blocks.texts_of(batch.column(1))
        load = payloads(texts)
        media = [wav(MULAW, load.text(i)) for i in range(len(load))]
        back = [read_wav(m)[2] for m in media]
        stored, at = np.frombuffer(b"".join(back), np.uint8), load.offsets
        linear = MULAW_TABLE[stored]
        adpcm = decode_adpcm(stored).ravel()
        changes = np.zeros(len(linear), np.int64)
        changes[1:] = (linear[1:] < 0) != (linear[:-1] < 0)
        changes[at[:-1]] = 0
        raw = memoryview(doubled(linear, at).astype("<i2").tobytes())
        pcm = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), at[1:].tolist())]
        files = [wav(PCM, bytes(p), 2 * RATE) for p in pcm]
        values = zip(_loudness(linear, at).tolist(), _loudness(ALAW_TABLE[stored], at).tolist(), _loudness(adpcm, at // BLOCK * SAMPLES).tolist(), np.add.reduceat(changes, at[:-1]).tolist(), map(zlib.crc32, pcm))
        hexed = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        columns = [
            pa.array(np.diff(texts.offsets)),
            pa.array([len(b) for b in back], pa.int64()),
            hexed(back),
            pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()),
            hexed(media),
            pa.array([f"mulaw:{a};alaw:{b};adpcm:{c};changes:{d};pcm:{e:08x}" for a, b, c, d, e in values]),
            pa.array([len(f) for f in files], pa.int64()),
            hexed(files),
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kinds = ["long", "long", "long", "string", "long", "long", "string", "string", "long", "string"]
    return id_text(docs).mapInArrow(per_block(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
