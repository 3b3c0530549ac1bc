"""Progressive JPEG (4:2:0, Huffman) from and to coefficient arrays, in numpy.

The decoder adds up the scans of a file, whatever their order of spectral selection and successive approximation, into one
coefficient array per component, and then transforms, upsamples and converts to RGB. Scans in which every block has as many
bits as any other (as the encoder writes them) are read as arrays; others are read symbol by symbol.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed value of the format: zigzag place of each coefficient of a block, by rows.
_DIAGONALS = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
NATURAL = np.array([8 * r + c for r, c in _DIAGONALS])
_K = np.arange(8)
_COSINES = np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)
#: From 64 coefficients in zigzag order to 64 samples by rows.
INVERSE = np.kron(_COSINES, _COSINES).T[NATURAL].astype(np.float32)
DC_ZERO, AC_WHOLE, AC_END = {0: 1}, {8: 1}, {0: 1}  # symbol: bits of its code


@dataclass
class Component:
    across: int  # sampling factors
    down: int
    table: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8 bits: inverse transform, chroma upsampled by repetition, YCbCr to RGB."""
        most_across, most_down = max(c.across for c in self.components.values()), max(c.down for c in self.components.values())
        planes = []
        for c in self.components.values():
            rows, columns, _ = c.blocks.shape
            scaled = c.blocks.reshape(-1, 64).astype(np.float32) * self.quantisation[c.table]
            plane = (scaled @ INVERSE).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * columns) + np.float32(128)
            np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
            for axis, times in ((0, most_down // c.down), (1, most_across // c.across)):
                if times > 1:
                    plane = np.repeat(plane, times, axis=axis)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            planes *= 3
            return np.stack(planes, axis=2).astype(np.uint8)
        y, blue, red = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        out = np.empty((self.height, self.width, 3), np.float32)
        out[..., 0] = y + np.float32(1.402) * red
        out[..., 1] = y - np.float32(0.344136) * blue - np.float32(0.714136) * red
        out[..., 2] = y + np.float32(1.772) * blue
        return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, which: int, codes: dict[int, int]) -> bytes:
    counts = [sum(bits == n for bits in codes.values()) for n in range(1, 17)]
    return _segment(0xC4, bytes([kind << 4 | which, *counts, *sorted(codes, key=codes.get)]))


def _scan(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    """bits: 0 and 1; the last byte is filled up with ones."""
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    header = bytes([len(parts), *(x for c, dc, ac in parts for x in (c, dc << 4 | ac)), first, last, high << 4 | low])
    return _segment(0xDA, header) + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def shape_of(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 units (four luma blocks and two of chroma each) for so many blocks."""
    units = -(-blocks // 6)
    columns = int(np.ceil(np.sqrt(units)))
    return -(-units // columns), columns


_TABLES = _segment(0xDB, bytes([0, *[1] * 64])) + _huffman(0, 0, DC_ZERO) + _huffman(1, 0, AC_WHOLE) + _huffman(1, 1, AC_END)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the bytes of ``payload`` (a positive multiple of 64).

    DC coefficients are bytes as they are and come bit by bit in refinement scans; AC coefficients are bytes + 256, so that all
    have nine bits: eight in a first scan of a low and one of a high band, the last in a refinement scan.
    """
    rows, columns = shape_of(len(payload) // 64)
    blocks = np.zeros((6 * rows * columns, 64), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    cuts = (0, 4 * rows * columns, 5 * rows * columns, 6 * rows * columns)
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xC2, frame), _TABLES]
    every = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    dc = np.empty((rows, columns, 6), np.uint8)  # in the order of interleaved units
    dc[..., :4] = blocks[: cuts[1], 0].reshape(rows, 2, columns, 2).transpose(0, 2, 1, 3).reshape(rows, columns, 4)
    dc[..., 4] = blocks[cuts[1] : cuts[2], 0].reshape(rows, columns)
    dc[..., 5] = blocks[cuts[2] :, 0].reshape(rows, columns)
    planes = np.unpackbits(dc.reshape(-1, 1), axis=1)
    out.append(_scan(every, 0, 0, 0, 8, np.zeros(len(planes), np.uint8)))
    out += [_scan(every, 0, 0, 8 - i, 7 - i, planes[:, i]) for i in range(8)]
    ac = np.zeros((len(blocks), 63, 9), np.uint8)  # code of one bit, then the first eight of nine bits, of which the first is one
    ac[..., 1] = 1
    bits = np.unpackbits(blocks[:, 1:, None], axis=2)
    ac[..., 2:] = bits[..., :7]
    fine = np.zeros((len(blocks), 64), np.uint8)
    fine[:, 1:] = bits[..., 7]
    for c, start, stop in zip((1, 2, 3), cuts, cuts[1:], strict=False):
        out.append(_scan([(c, 0, 0)], 1, 5, 0, 1, ac[start:stop, :5].reshape(-1)))
        out.append(_scan([(c, 0, 0)], 6, 63, 0, 1, ac[start:stop, 5:].reshape(-1)))
        out.append(_scan([(c, 0, 1)], 1, 63, 1, 0, fine[start:stop].reshape(-1)))
    return b"".join([*out, b"\xff\xd9"])


def read_payload(image: Image) -> bytes:
    """What :func:`encode_payload` has stored."""
    blocks = np.concatenate([c.blocks.reshape(-1, 64) for c in image.components.values()])
    return blocks.astype(np.uint8).tobytes()[: int(image.comment.split()[1])]  # the low eight bits of each


class _Codes:
    """A Huffman table: symbol and length by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        values, lengths = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        self.only = (symbols[0], next(n for n, c in enumerate(counts, 1) if c)) if len(symbols) == 1 else None
        code, at = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                start = code << (16 - n)
                values[start : start + (1 << (16 - n))] = symbols[at]
                lengths[start : start + (1 << (16 - n))] = n
                code, at = code + 1, at + 1
            code <<= 1
        self.symbols, self.lengths = values.tobytes(), lengths.tobytes()  # single items of bytes are ints, and quick to read


class _Bits:
    """Bits of a scan, read forward: each byte's place has the 32 bits from there on, so that no read costs more in a long scan."""

    def __init__(self, data: bytes):
        ahead = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.uint32)
        self.ahead = memoryview(ahead[:-3] << 24 | ahead[1:-2] << 16 | ahead[2:-1] << 8 | ahead[3:])
        self.at, self.end = 0, 8 * len(data) + 24

    def take(self, n: int) -> int:
        """The next n bits, 16 at most."""
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the scan ends too early")
        return self.ahead[at >> 3] >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def symbol(self, codes: _Codes) -> int:
        at = self.at
        if at + 16 > self.end:
            raise ValueError("the scan ends too early")
        next16 = self.ahead[at >> 3] >> (16 - (at & 7)) & 0xFFFF
        length = codes.lengths[next16]
        if not length:
            raise ValueError("no such code")
        self.at = at + length
        return codes.symbols[next16]

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _refine(bits: _Bits, block: list[int], k: int, last: int, step: int, zeros: int) -> int:
    """Correction bits from k on, past so many coefficients that are zero so far; the place reached."""
    while k <= last:
        if block[k]:
            if bits.take(1) and not abs(block[k]) & step:
                block[k] += step if block[k] > 0 else -step
        elif zeros == 0:
            break
        else:
            zeros -= 1
        k += 1
    return k


def _slow(bits: _Bits, blocks: list[tuple[np.ndarray, _Codes | None, int]], first: int, last: int, high: int, low: int) -> None:
    """blocks: in scan order, each with its table and component."""
    before: dict[int, int] = {}
    run = 0
    for block, codes, which in blocks:
        if first == 0:
            if high:
                block[0] |= bits.take(1) << low
            else:
                before[which] = before.get(which, 0) + bits.signed(bits.symbol(codes))
                block[0] = before[which] << low
            continue
        row, k = block.tolist(), first
        while k <= last and not run:
            skip, size = divmod(bits.symbol(codes), 16)
            if size == 0 and skip < 15:
                run = (1 << skip) + bits.take(skip)
            elif high:
                value = (1 if bits.take(1) else -1) << low if size else 0
                k = _refine(bits, row, k, last, 1 << low, skip)
                if value and k <= last:
                    row[k] = value
                k += 1
            else:
                k += skip
                if size:
                    row[k] = bits.signed(size) * (1 << low)
                k += 1
        if run:
            if high:
                _refine(bits, row, k, last, 1 << low, 64)
            run -= 1
        block[:] = row


def _fast(data: bytes, component: Component, codes: _Codes, rows: int, columns: int, first: int, last: int, high: int, low: int) -> bool:
    """An AC scan of one code in which all coefficients (first scan), or no new ones (refinement), come in every block."""
    count, band = rows * columns, last - first + 1
    if not codes.only or codes.only[1] != 1 or component.blocks.shape[:2] != (rows, columns):
        return False
    blocks = component.blocks.reshape(-1, 64)
    size = codes.only[0]
    each = 1 + band if high else band * (1 + size)
    if len(data) != -(-count * each // 8) or (size if high else not 0 < size < 10):
        return False
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * each)
    if high:
        bits = bits.reshape(count, each)
        now = blocks[:, first : last + 1]
        if bits[:, 0].any() or not now.all():
            return False
        now += (np.where(now > 0, bits[:, 1:], -bits[:, 1:].astype(np.int8)) if (now < 0).any() else bits[:, 1:]).astype(np.int16) * ((now & (1 << low)) == 0) * (1 << low)
        return True
    bits = bits.reshape(count, band, 1 + size)
    if bits[..., 0].any():
        return False
    value = np.packbits(bits[..., 1:], axis=2)
    value = (value[..., 0].astype(np.int16) << 8 | value[..., 1]) >> (16 - size) if size > 8 else value[..., 0].astype(np.int16) >> (8 - size)
    if not bits[..., 1].all():
        value = np.where(bits[..., 1], value, value - (1 << size) + 1)
    blocks[:, first : last + 1] = value << low
    return True


def decode(data: bytes) -> Image:
    """Coefficients, tables and comment of a progressive JPEG without restart markers."""
    image, tables, at = Image(), {}, 2
    most_across = most_down = 1
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data) - 1:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            for i in range(n):
                which, factors, table = body[6 + 3 * i : 9 + 3 * i]
                image.components[which] = Component(factors >> 4, factors & 15, table)
            most_across, most_down = max(c.across for c in image.components.values()), max(c.down for c in image.components.values())
            units = -(-image.height // (8 * most_down)), -(-image.width // (8 * most_across))
            for c in image.components.values():
                c.blocks = np.zeros((units[0] * c.down, units[1] * c.across, 64), np.int16)
        elif marker == 0xDA:
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1]:
                    break
                end += 2
            coded, at = data[at:end].replace(b"\xff\x00", b"\xff"), end
            _read_scan(image, tables, body, coded, most_across, most_down)
        elif marker in (0xC0, 0xC1, 0xDD) or 0xC3 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman files without restart markers")
    return image


_KNOWN: dict[tuple[bytes, bytes], _Codes] = {}


def _codes(counts: bytes, symbols: bytes) -> _Codes:
    if (counts, symbols) not in _KNOWN:
        if len(_KNOWN) > 64:
            _KNOWN.clear()
        _KNOWN[counts, symbols] = _Codes(counts, symbols)
    return _KNOWN[counts, symbols]


def _read_scan(image: Image, tables: dict[int, _Codes], body: bytes, coded: bytes, most_across: int, most_down: int) -> None:
    n = body[0]
    parts = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    chosen = [(image.components[c], tables.get(ac | 16 if first else dc), c) for c, dc, ac in parts]
    if n == 1:  # only blocks that hold some of the image
        c = chosen[0][0]
        rows, columns = -(-image.height * c.down // (8 * most_down)), -(-image.width * c.across // (8 * most_across))
        if first and _fast(coded, c, chosen[0][1], rows, columns, first, last, high, low):
            return
        order = [(c.blocks[r, k], chosen[0][1], chosen[0][2]) for r in range(rows) for k in range(columns)]
        _slow(_Bits(coded), order, first, last, high, low)
        return
    units = -(-image.height // (8 * most_down)), -(-image.width // (8 * most_across))
    each = [c.across * c.down for c, _, _ in chosen]
    if high and len(coded) == -(-units[0] * units[1] * sum(each) // 8):
        bits = np.unpackbits(np.frombuffer(coded, np.uint8), count=units[0] * units[1] * sum(each)).reshape(*units, sum(each))
        at = 0
        for (c, _, _), m in zip(chosen, each, strict=True):
            part = bits[..., at : at + m].reshape(*units, c.down, c.across).transpose(0, 2, 1, 3).reshape(c.blocks.shape[:2])
            c.blocks[..., 0] |= part.astype(np.int16) << low
            at += m
        return
    if not high and all(t.only == (0, 1) for _, t, _ in chosen):
        return  # all differences are zero
    order = [(c.blocks[r * c.down + i, k * c.across + j], t, w) for r in range(units[0]) for k in range(units[1]) for c, t, w in chosen for i in range(c.down) for j in range(c.across)]
    _slow(_Bits(coded), order, first, last, high, low)
