"""Frames of any FLAC stream, read one by one: all subframes, Rice partitions, block sizes and channel forms.

Cases: a stream without samples has no frames; a frame whose CRC-8 or CRC-16 is wrong, a reserved
code, a residual that does not fit its block and a stream that ends inside a frame raise ``ValueError``.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

# Fixed values of the format: the CRC polynomials, the predictors of orders 0 to 4, the sample sizes by code.
CRC8, CRC16 = 0x07, 0x8005
PREDICTORS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def crc_table(bits: int, poly: int) -> list[int]:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for n in range(256):
        c = n << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_T8, _T16 = crc_table(8, CRC8), crc_table(16, CRC16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _T8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _T16[(c >> 8) ^ b]
    return c


class Meta(NamedTuple):
    block: tuple[int, int]  # smallest and largest
    channels: int
    bits: int
    total: int  # samples of a channel; 0 if unknown
    md5: bytes  # zeros if unknown
    seeks: list[tuple[int, int]]  # sample, byte after ``begin``
    begin: int  # where the frames begin


def parse(stream: bytes) -> Meta:
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info, seeks = 4, False, None, []
    while not last:
        head = stream[at : at + 4]
        size = int.from_bytes(head[1:], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(head) < 4 or len(body) < size:
            raise ValueError("the stream ends inside its metadata")
        last, kind = bool(head[0] & 0x80), head[0] & 0x7F
        if kind == 0:
            info = body
        elif kind == 3:  # points of all ones hold a place only
            seeks = [(s, b) for s, b, _ in struct.iter_unpack(">QQH", body) if s != (1 << 64) - 1]
        at += 4 + size
    if info is None or len(info) < 34:
        raise ValueError("no STREAMINFO")
    word = int.from_bytes(info[10:18], "big")
    block = (int.from_bytes(info[:2], "big"), int.from_bytes(info[2:4], "big"))
    return Meta(block, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & ((1 << 36) - 1), info[18:34], seeks, at)


def read_number(data: bytes, at: int) -> tuple[int, int]:
    """A number in the format's extended UTF-8, and where it ends."""
    if at >= len(data):
        raise ValueError("the stream ends inside a frame")
    lead = data[at]
    if lead < 0x80:
        return lead, at + 1
    count = next((k for k in range(1, 7) if not lead & (0x40 >> k)), 0)
    if not lead & 0x40 or not count:
        raise ValueError("a frame's number is damaged")
    value = lead & (0x3F >> count)
    for b in data[at + 1 : at + 1 + count]:
        value = (value << 6) | (b & 0x3F)
    return value, at + 1 + count


class Bits:
    """Bits of a byte string from a byte on, the highest first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        end = self.pos + n
        if end > len(self.data) * 8:
            raise ValueError("the stream ends inside a frame")
        window = int.from_bytes(self.data[self.pos >> 3 : (end + 7) >> 3], "big")
        self.pos = end
        return window >> (-end & 7) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        """How many zeros stand before the next one, which is passed too."""
        begin, at = self.pos, self.pos >> 3
        if at >= len(self.data):
            raise ValueError("the stream ends inside a frame")
        byte = self.data[at] & (0xFF >> (begin & 7))
        while not byte:
            at += 1
            if at >= len(self.data):
                raise ValueError("the stream ends inside a frame")
            byte = self.data[at]
        one = at * 8 + 8 - byte.bit_length()
        self.pos = one + 1
        return one - begin


def residual(b: Bits, size: int, order: int) -> list[int]:
    """The Rice-coded differences from the prediction, partition by partition."""
    method, parts = b.take(2), b.take(4)
    if method > 1 or size % (1 << parts) or size >> parts < order:
        raise ValueError("a frame's residual is damaged")
    wide = 4 + method
    out = []
    for k in range(1 << parts):
        n, rice = (size >> parts) - (order if k == 0 else 0), b.take(wide)
        if rice == (1 << wide) - 1:  # the partition is not coded
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = b.zeros() << rice | b.take(rice)
                out.append(u >> 1 ^ -(u & 1))
    return out


def subframe(b: Bits, size: int, bits: int) -> list[int]:
    """One channel's samples: constant, verbatim, or a linear prediction with its residual."""
    if b.take(1):
        raise ValueError("a subframe is damaged")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.zeros() + 1
        bits -= wasted
    if bits <= 0:
        raise ValueError("a subframe is damaged")
    if kind == 0:
        out = [b.signed(bits)] * size
    elif kind == 1:
        out = [b.signed(bits) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        out = [b.signed(bits) for _ in range(order)]
        if kind >= 32:
            wide, shift = b.take(4) + 1, b.signed(5)
            if wide == 16 or shift < 0:
                raise ValueError("a subframe's coefficients are damaged")
            weights = [b.signed(wide) for _ in range(order)]
        else:
            weights, shift = list(PREDICTORS[order]), 0
        weights.reverse()  # the oldest sample first
        for e in residual(b, size, order):
            before = out[-order:] if order else []
            out.append(e + (sum(w * v for w, v in zip(weights, before, strict=True)) >> shift))
    else:
        raise ValueError("an unknown kind of subframe")
    if len(out) != size:
        raise ValueError("a subframe is longer than its block")
    return [v << wasted for v in out] if wasted else out


def read(stream: bytes, at: int, block: tuple[int, int], bits: int) -> tuple[int, np.ndarray, int]:
    """The frame at byte ``at``: its first sample, its samples (a column for each channel) and the byte after it."""
    head = stream[at : at + 4]
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise ValueError("no frame begins here")
    size_code, rate_code, form, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if not size_code or rate_code == 15 or form > 10 or bits_code == 3 or head[3] & 1:
        raise ValueError("a frame's header is damaged")
    number, end = read_number(stream, at + 4)
    if size_code in (6, 7):
        wide = size_code - 5
        size = int.from_bytes(stream[end : end + wide], "big") + 1
        end += wide
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    end += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if end >= len(stream) or crc8(stream[at:end]) != stream[end]:
        raise ValueError("a frame's CRC-8 is wrong")
    first = number if head[1] & 1 else number * block[0]
    bits = SAMPLE_BITS.get(bits_code, bits)
    b = Bits(stream, end + 1)
    sides = {8: 1, 9: 0, 10: 1}  # the channel that holds the difference has a bit more
    channels = [subframe(b, size, bits + (sides.get(form) == c)) for c in range(form + 1 if form < 8 else 2)]
    x = np.array(channels, np.int64)
    if form == 8:  # left, side
        x[1] = x[0] - x[1]
    elif form == 9:  # side, right
        x[0] = x[0] + x[1]
    elif form == 10:  # mid, side
        mid = x[0] * 2 + (x[1] & 1)
        x[0], x[1] = (mid + x[1]) >> 1, (mid - x[1]) >> 1
    end = (b.pos + 7) // 8
    if crc16(stream[at:end]) != int.from_bytes(stream[end : end + 2], "big") or end + 2 > len(stream):
        raise ValueError("a frame's CRC-16 is wrong")
    return first, x.T, end + 2


def pcm_of(samples: np.ndarray, bits: int) -> bytes:
    """Samples as WAV files have them: up to 8 bits unsigned, wider ones signed and little-endian."""
    wide = -(-bits // 8)
    if wide == 1:
        return (samples.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
    return np.ascontiguousarray(samples).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def frames(stream: bytes, meta: Meta, at: int):
    """``(sample offset, pcm, byte offset)`` of each frame from byte ``at`` on."""
    while at < len(stream):
        first, samples, end = read(stream, at, meta.block, meta.bits)
        if samples.shape[1] != meta.channels:
            raise ValueError("a frame has another number of channels")
        yield first, pcm_of(samples, meta.bits), at
        at = end


def pieces(stream: bytes, meta: Meta):
    """``(sample offset, byte offset, pcm)``, a piece for each seek point, or for each frame where there is none."""
    points = {s: b for s, b in meta.seeks}
    want, held, begin, seen = 0, [], None, set()
    for first, pcm, at in frames(stream, meta, meta.begin):
        if first != want:
            raise ValueError("a frame is missing")
        want += len(pcm) // (meta.channels * -(-meta.bits // 8))
        if begin is not None and (first in points or not points):
            yield *begin, b"".join(held)
            begin, held = None, []
        if first in points:
            if points[first] != at - meta.begin:
                raise ValueError("a seek point is at no frame")
            seen.add(first)
        begin = begin or (first, at)
        held.append(pcm)
    if seen != set(points):
        raise ValueError("a seek point is at no frame")
    if meta.total and want != meta.total:
        raise ValueError("the stream ends before its last sample")
    if begin is not None:
        yield *begin, b"".join(held)
