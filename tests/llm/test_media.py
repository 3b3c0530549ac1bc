import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from cases import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jpeg, media

NATURAL = jpeg.NATURAL


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3_000))
def test_payload_round_trip(data):
    payload = data + bytes(-len(data) % 64)
    assert jpeg.read_payload(jpeg.decode(jpeg.encode_payload(payload))) == payload


def test_slow_reading_gives_the_same(monkeypatch):
    payload = np.random.default_rng(0).integers(0, 256, 64 * 40).astype(np.uint8).tobytes()
    fast = jpeg.decode(jpeg.encode_payload(payload))
    monkeypatch.setattr(jpeg, "_fast", lambda *a: False)
    slow = jpeg.decode(jpeg.encode_payload(payload))
    assert all((fast.components[c].blocks == slow.components[c].blocks).all() for c in fast.components)


@pytest.mark.parametrize("at", range(8))
def test_bits_from_any_place(at):
    """Reads of up to 16 bits across bytes, the filled-up end included, and none beyond it."""
    data = bytes(random.Random(at).randrange(256) for _ in range(40))
    plain = "".join(f"{b:08b}" for b in data) + "1" * 24
    bits, place = jpeg._Bits(data), at
    bits.take(at)
    for n in [*range(17), 3, 16, 11] * 3:
        if place + n > len(plain):
            with pytest.raises(ValueError):
                bits.take(n)
            break
        assert bits.take(n) == int(plain[place : place + n] or "0", 2)
        place += n
    else:
        assert False


class Writer:
    """Codes of nine bits for all symbols in use, as a plain encoder of any coefficients would write them."""

    SYMBOLS = sorted({r << 4 | s for r in range(16) for s in range(11)})

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(self.SYMBOLS.index(s), 9)

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def scan(self, parts, first, last, high, low):
        return jpeg._scan(parts, first, last, high, low, np.array(self.bits, np.uint8))


def shifted(v, low):
    return int(abs(v) >> low) * (1 if v > 0 else -1)


def ac_first(blocks, first, last, low):
    out, run_of_ends = Writer(), 0

    def flush():
        nonlocal run_of_ends
        if run_of_ends:
            n = run_of_ends.bit_length() - 1
            out.symbol(n << 4)
            out.put(run_of_ends - (1 << n), n)
            run_of_ends = 0

    for block in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = shifted(block[k], low)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                out.symbol(0xF0)
                zeros -= 16
            out.symbol(zeros << 4 | abs(v).bit_length())
            out.signed(v)
            zeros = 0
        if zeros:
            run_of_ends += 1
            if run_of_ends == 1000:
                flush()
    flush()
    return out


def ac_refine(blocks, first, last, low):
    out = Writer()
    for block in blocks:
        size = [abs(int(v)) >> low for v in block]
        end = max((k for k in range(first, last + 1) if size[k] == 1), default=0)
        zeros, held = 0, []
        for k in range(first, last + 1):
            if not size[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= end:
                out.symbol(0xF0)
                out.bits += held
                zeros, held = zeros - 16, []
            if size[k] > 1:
                held.append(size[k] & 1)
                continue
            out.symbol(zeros << 4 | 1)
            out.bits += [int(block[k] > 0), *held]
            zeros, held = 0, []
        if zeros or held:
            out.symbol(0)
            out.bits += held
    return out


@pytest.mark.parametrize("seed", range(4))
def test_any_coefficients(seed):
    """Sparse coefficients of either sign, in bands, runs of ends, and two refinements, give themselves back."""
    rng = random.Random(seed)
    rows, columns = rng.randrange(1, 5), rng.randrange(1, 5)
    blocks = [[rng.randrange(-500, 500) if k == 0 else rng.choice([0] * 8 + [1, -1, 2, -3, 7, -20, 90]) if rng.random() < 0.5 else 0 for k in range(64)] for _ in range(rows * columns)]
    dc, before = Writer(), 0
    for b in blocks:
        step, before = (b[0] >> 1) - before, b[0] >> 1
        dc.symbol(abs(step).bit_length())
        dc.signed(step) if step else None
    fine = Writer()
    fine.bits = [b[0] & 1 for b in blocks]
    one = [(1, 0, 0)]
    codes = {s: 9 for s in Writer.SYMBOLS}
    parts = [
        b"\xff\xd8",
        jpeg._segment(0xDB, bytes([0, *range(1, 65)])),
        jpeg._huffman(0, 0, codes),
        jpeg._huffman(1, 0, codes),
        jpeg._segment(0xC2, struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 1) + bytes([1, 0x11, 0])),
        dc.scan(one, 0, 0, 0, 1),
        ac_first(blocks, 1, 5, 2).scan(one, 1, 5, 0, 2),
        ac_first(blocks, 6, 63, 2).scan(one, 6, 63, 0, 2),
        ac_refine(blocks, 1, 63, 1).scan(one, 1, 63, 2, 1),
        fine.scan(one, 0, 0, 1, 0),
        ac_refine(blocks, 1, 63, 0).scan(one, 1, 63, 1, 0),
        b"\xff\xd9",
    ]
    image = jpeg.decode(b"".join(parts))
    assert image.components[1].blocks.reshape(-1, 64).tolist() == blocks
    first = np.array(blocks[0]) * np.arange(1, 65)
    square = np.zeros((8, 8))
    for k, at in enumerate(NATURAL):
        square[at // 8, at % 8] = first[k]
    c = lambda n: np.sqrt(0.5) if n == 0 else 1.0
    plain = [[sum(0.25 * c(u) * c(v) * square[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128 for x in range(8)] for y in range(8)]
    assert np.abs(image.rgb()[:8, :8, 0].astype(float) - np.clip(plain, 0, 255)).max() <= 1


@pytest.mark.parametrize("rows", [awkward(), []])
def test_contract(spark, rows):
    df = media.digests(media.decode_media(media.encode_media(documents(spark, rows, media="clash")), tensors=False))
    found = {}
    for r in df.collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        for r in found[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64 and r["feature"]
    assert len({(r["media_sha256"], r["feature"]) for i in (5, 6) for r in found.get(i, [])}) <= 1


def test_tensors(spark):
    rows = media.decode_media(media.encode_media(documents(spark, [(1, "abc " * 200)]))).collect()
    assert len(rows[0]["rgb"]) == rows[0]["height"] * rows[0]["width"] * 3
