import hashlib
import struct
import zlib

import numpy as np
import pytest

from tallyloom.llm import telephony as t


def adpcm_by_hand(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def doubled_by_hand(x):
    at = lambda i: int(x[max(0, min(len(x) - 1, i))])
    out = []
    for i in range(len(x)):
        out += [at(i), max(-32768, min(32767, (3 * at(i - 2) - 25 * at(i - 1) + 150 * at(i) + 150 * at(i + 1) - 25 * at(i + 2) + 3 * at(i + 3) + 128) >> 8))]
    return out


def test_tables():
    assert [int(t.MULAW_TABLE[i]) for i in (0, 0x80, 0x7F, 0xFF, 0xF0)] == [-32124, 32124, 0, 0, 120]
    assert [int(t.ALAW_TABLE[i]) for i in (0xD5, 0x55, 0x2A, 0xAA)] == [8, -8, -32256, 32256]


def test_adpcm_and_resampling():
    raw = np.random.default_rng(2).integers(0, 256, 7 * t.BLOCK, dtype=np.uint8)
    got = t.decode_adpcm(raw)
    assert got.tolist() == [adpcm_by_hand(raw[k : k + t.BLOCK].tobytes()) for k in range(0, len(raw), t.BLOCK)]
    x = t.MULAW_TABLE[raw]
    offsets = np.array([0, 0, 1, 3, 9, 9, 700, len(x)])
    want = [v for a, b in zip(offsets, offsets[1:]) for v in doubled_by_hand(x[a:b])]
    assert t.doubled(x, offsets).tolist() == want
    assert len(t.doubled(x[:0], np.array([0]))) == 0


@pytest.mark.parametrize("kind", [t.MULAW, t.ALAW, t.ADPCM, t.PCM])
def test_files_round_trip(kind):
    raw = bytes(range(256)) * 3
    assert t.read_wav(t.wav(kind, raw)) == (kind, t.RATE, raw)


def test_payloads(spark, awkward, empty):
    want = {}
    for doc_id, text in awkward.select("doc_id", "text").collect():
        raw = (text or "").encode()
        load = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = t.wav(t.MULAW, load)
        want[doc_id] = (len(raw), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]), len(media), hashlib.sha256(media).hexdigest())
        x = t.MULAW_TABLE[np.frombuffer(load, np.uint8)].astype(np.int64)
        if len(load) <= 2000:
            pcm = np.array(doubled_by_hand(x), "<i2").tobytes()
            adpcm = np.array([v for k in range(0, len(load), 192) for v in adpcm_by_hand(load[k : k + 192])], np.int64)
            a = t.ALAW_TABLE[np.frombuffer(load, np.uint8)].astype(np.int64)
            want[doc_id] += (f"mulaw:{(x**2).sum() // len(x)};alaw:{(a**2).sum() // len(a)};adpcm:{(adpcm**2).sum() // len(adpcm)};changes:{((x[1:] < 0) != (x[:-1] < 0)).sum()};pcm:{zlib.crc32(pcm):08x}", len(pcm) + 44)
    rows = t.digest_payloads(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert tuple(r)[1 : 1 + len(want[r.doc_id])] == want[r.doc_id]
    assert t.digest_payloads(empty).collect() == []


def test_media_column(spark):
    raw = bytes(range(192)) * 2
    rows = [(1, t.wav(t.ALAW, raw)), (2, None), (3, b"RIFF broken"), (4, t.wav(t.ADPCM, raw)), (5, t.wav(t.PCM, b"")), (6, b"")]
    got = {r.id: r for r in t.to_pcm(spark.createDataFrame(rows, "id int, clip binary"), "id", "clip").collect()}
    assert got[1].samples == 768 and got[4].samples == 4 * t.SAMPLES and got[5].samples == 0
    assert np.frombuffer(t.read_wav(bytes(got[1].pcm))[2], "<i2").tolist() == doubled_by_hand(t.ALAW_TABLE[np.frombuffer(raw, np.uint8)])
    assert got[1].rate == 16000 and all(got[k].pcm is None and got[k].samples is None for k in (2, 3, 6))
