"""Media columns: FLAC streams, encoded and decoded in Arrow batches.

The encoder writes what text columns need: mono, 8 bits, blocks of 576 samples, constant,
verbatim and fixed-predictor subframes (orders 0 to 4), one Rice partition for each block.
The stream has STREAMINFO (with the MD5 of the samples) and a SEEKTABLE with an entry for
every ``seek_every`` blocks, so that a reader can start at any sample offset.  A decoder
checks the CRC-8 of every frame header, the CRC-16 of every frame, the places in the
SEEKTABLE and the MD5 of the whole.

All blocks of a batch of such streams are worked on together as rows of arrays: a step of the
decoder moves every block one residual on.  Streams of other encoders, and blocks with
coefficients of their own or several Rice partitions, are read frame by frame
(``flac_frames``): all predictors, partition orders, block sizes, up to 8 channels and 32 bits.

PCM is given as WAV files have it: 8-bit samples unsigned, wider ones signed and little-endian,
channels interleaved; a sample offset counts samples of one channel.

Cases: null and empty texts are one block of padding; a very long text is read back in pieces
of ``seek_every`` blocks; every sequence of bytes comes back exactly; repeated rows stay and
equal payloads give equal streams whatever their batch; only the named columns are read, so
others may have any name; an empty table gives an empty result; a damaged stream raises
``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac_frames
from .flac_frames import CRC8, CRC16, crc8, crc16, crc_table, read_number

BLOCK = 576
LONGEST = BLOCK + 24  # bytes of a frame
RATE = 16_000


_T8, _T16 = (np.array(crc_table(*kind), np.uint32) for kind in ((8, CRC8), (16, CRC16)))


def _crcs(rows: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of the first ``sizes[i]`` bytes of each row, all rows at once."""
    table, shift, mask = (_T8, 0, 0xFF) if bits == 8 else (_T16, 8, 0xFFFF)
    crc = np.zeros(len(rows), np.uint32)
    order = np.argsort(-sizes, kind="stable")  # rows still running are a prefix
    left = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    cols = np.ascontiguousarray(rows[order].T)
    for k, n in enumerate(left.tolist()):
        c = crc[:n]
        crc[:n] = (((c << 8) & mask) ^ table[(c >> shift) ^ cols[k, :n]]) if bits == 16 else table[c ^ cols[k, :n]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    count = next(k for k, top in enumerate((1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31, 1 << 36), 1) if n < top)
    lead = (0xFF00 >> (count + 1)) & 0xFF
    tail = [0x80 | ((n >> (6 * k)) & 0x3F) for k in range(count - 1, -1, -1)]
    return bytes([lead | (n >> (6 * count)), *tail])


def _header(number: int) -> bytes:
    # sync and fixed block size; 576 samples, rate from STREAMINFO; mono, 8 bits
    return b"\xff\xf8" + bytes([0x20, 0x02]) + _utf8_number(number)


def encode_blocks(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """A frame for each row of ``samples`` (signed, BLOCK wide) with its frame number."""
    n = len(samples)
    x = samples.astype(np.int32)
    residuals = [x]
    for _ in range(4):
        residuals.append(np.diff(residuals[-1], axis=1))
    cost = np.stack([np.abs(r[:, 4 - k :]).sum(axis=1) for k, r in enumerate(residuals)])
    order = cost.argmin(axis=0)
    heads = [_header(int(k)) for k in numbers]
    sizes = np.array([len(h) for h in heads])
    rows = np.zeros((n, int(sizes.max(initial=0))), np.uint8)
    for i, h in enumerate(heads):
        rows[i, : len(h)] = np.frombuffer(h, np.uint8)
    crc8 = _crcs(rows, sizes, 8)
    frames: list[bytes] = [b""] * n
    for k in range(5):
        pick = np.flatnonzero(order == k)
        if not len(pick):
            continue
        r = residuals[k][pick]
        u = (r << 1) ^ (r >> 31)  # zigzag: small magnitudes become small numbers
        sums = np.stack([(u >> p).sum(axis=1) + u.shape[1] * (1 + p) for p in range(9)])
        rice = sums.argmin(axis=0)
        bits = 8 + 8 * k + 6 + 4 + sums.min(axis=0)
        plain = bits >= 8 + 8 * BLOCK  # a verbatim subframe is shorter
        same = (x[pick] == x[pick][:, :1]).all(axis=1)
        width = np.where(same, 16, np.where(plain, 8 + 8 * BLOCK, bits))
        flat = np.zeros((len(pick), (int(width.max()) + 7) // 8 * 8), np.uint8)

        def put(rows_, at, value, count, flat=flat):
            for b in range(count):
                flat[rows_, at + b] = (value >> (count - 1 - b)) & 1

        a = np.flatnonzero(same)
        if len(a):
            put(a, 8, x[pick][a, 0] & 0xFF, 8)
        v = np.flatnonzero(~same & plain)
        if len(v):
            put(v, 1, 1, 6)
            flat[v, 8 : 8 + 8 * BLOCK] = np.unpackbits((x[pick][v] & 0xFF).astype(np.uint8), axis=1)
        f = np.flatnonzero(~same & ~plain)
        if len(f):
            put(f, 1, 8 | k, 6)
            for j in range(k):
                put(f, 8 + 8 * j, x[pick][f, j] & 0xFF, 8)
            put(f, 8 + 8 * k + 6, rice[f], 4)
            p = rice[f][:, None]
            q = u[f] >> p
            stop = 18 + 8 * k + np.cumsum(q + 1 + p, axis=1)  # where each code ends
            one = stop - 1 - p
            rows_ = np.broadcast_to(f[:, None], one.shape)
            flat[rows_, one] = 1
            for b in range(int(rice[f].max(initial=0))):
                has = np.broadcast_to(p > b, one.shape)
                flat[rows_[has], (stop - 1 - b)[has]] = ((u[f] >> b) & 1)[has]
        packed = np.packbits(flat, axis=1)
        body = (width + 7) // 8
        total = sizes[pick] + 1 + body
        out = np.zeros((len(pick), int(total.max()) + 2), np.uint8)
        for size in np.unique(sizes[pick]).tolist():
            at = np.flatnonzero(sizes[pick] == size)
            out[at, :size] = rows[pick[at], :size]
            out[at, size] = crc8[pick[at]]
            out[at, size + 1 : size + 1 + packed.shape[1]] = packed[at, : out.shape[1] - size - 1]
        crc = _crcs(out, total, 16)
        span = np.arange(len(pick))
        out[span, total] = crc >> 8
        out[span, total + 1] = crc & 0xFF
        for row, i, t in zip(out, pick.tolist(), (total + 2).tolist(), strict=True):
            frames[i] = row[:t].tobytes()
    return frames


def wrap(frames: list[bytes], payload: bytes, seek_every: int = 64) -> bytes:
    """The stream: marker, STREAMINFO, SEEKTABLE, frames."""
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(_signed(payload)).digest()
    table, at = b"", 0
    for k, size in enumerate(sizes):
        if k % seek_every == 0:
            table += struct.pack(">QQH", k * BLOCK, at, BLOCK)
        at += size
    meta = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
    return b"fLaC" + meta + b"".join(frames)


def _signed(payload: bytes) -> bytes:
    """Unsigned bytes as signed 8-bit samples."""
    return (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a payload is a positive multiple of BLOCK bytes."""
    counts = [len(p) // BLOCK for p in payloads]
    if not counts:
        return []
    x = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    frames = encode_blocks(x, np.concatenate([np.arange(c) for c in counts]))
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        out.append(wrap(frames[at : at + c], p))
        at += c
    return out


def _own(stream: bytes, meta: flac_frames.Meta) -> bool:
    """Whether the stream has the form that ``encode`` writes, so that its blocks are rows of one width."""
    head = _header(0)
    same = (meta.block, meta.channels, meta.bits) == ((BLOCK, BLOCK), 1, 8) and meta.total > 0 and meta.total % BLOCK == 0
    return same and stream[meta.begin : meta.begin + len(head) + 1] == head + bytes([crc8(head)])


def pieces(streams: list[bytes]):
    """``(stream, sample offset, byte offset, pcm)`` in order, a piece for each seek point; all checksums verified.

    Frames of several streams are decoded together, 2,048 at a time.
    """
    metas = [flac_frames.parse(s) for s in streams]
    waiting: list[tuple] = []  # pieces of own streams: stream, sample, byte, frames, number of the first
    held = 0

    def ready():
        nonlocal held
        if not waiting:
            return
        x = decode_blocks([f for *_, frames, _ in waiting for f in frames], [k for *_, frames, first in waiting for k in range(first, first + len(frames))])
        at = 0
        for o, sample, byte, frames, _ in waiting:
            yield o, sample, byte, (x[at : at + len(frames)].reshape(-1).view(np.uint8) ^ 0x80).tobytes()
            at += len(frames)
        waiting.clear()
        held = 0

    def made():
        nonlocal held
        for o, (s, m) in enumerate(zip(streams, metas, strict=True)):
            if not _own(s, m):
                yield from ready()
                yield from ((o, *piece) for piece in flac_frames.pieces(s, m))
                continue
            starts = _frame_starts(s, m.begin, m.total // BLOCK)
            if any(p % BLOCK or p // BLOCK >= len(starts) - 1 or starts[p // BLOCK] != m.begin + at for p, at in m.seeks):
                raise ValueError("a seek point is at no frame")
            cuts = sorted({0, *(p // BLOCK for p, _ in m.seeks), len(starts) - 1}) if m.seeks else range(len(starts))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                waiting.append((o, lo * BLOCK, starts[lo], [s[a:b] for a, b in zip(starts[lo:hi], starts[lo + 1 : hi + 1], strict=True)], lo))
                held += hi - lo
                if held >= 2048:
                    yield from ready()
        yield from ready()

    last, total, md5 = -1, 0, hashlib.md5()

    def close():
        if last >= 0 and ((metas[last].total and metas[last].total != total) or (any(metas[last].md5) and md5.digest() != metas[last].md5)):
            raise ValueError("the samples don't match the stream's length or MD5")

    for o, sample, byte, pcm in made():
        if o != last:
            close()
            last, total, md5 = o, 0, hashlib.md5()
        total += len(pcm) // (metas[o].channels * -(-metas[o].bits // 8))
        md5.update(_signed(pcm) if metas[o].bits <= 8 else pcm)
        yield o, sample, byte, pcm
    close()


def decode(streams: list[bytes]) -> list[bytes]:
    """The PCM of each stream, all checksums verified."""
    out: list[list[bytes]] = [[] for _ in streams]
    for o, _, _, pcm in pieces(streams):
        out[o].append(pcm)
    return [b"".join(p) for p in out]


def _frame_starts(stream: bytes, begin: int, count: int) -> list[int]:
    """Where the frames begin: sync codes whose number is the next and whose CRC-8 is right."""
    starts, at = [], begin
    for k in range(count):
        head = _header(k)
        want = head + bytes([crc8(head)])
        at = stream.find(want, at)
        # The same bytes may also occur inside a frame: then the CRC-16 before the start decides.
        if k and at >= 0 and stream.find(want, at + 1, starts[-1] + LONGEST + len(want)) >= 0:
            while at >= 0 and not _whole(stream[starts[-1] : at]):
                at = stream.find(want, at + 1)
        if at < 0 or (k == 0 and at != begin):
            raise ValueError(f"frame {k} is damaged")
        starts.append(at)
        at += len(want)
    return [*starts, len(stream)]


def _whole(frame: bytes) -> bool:
    """Whether the last two bytes are the CRC-16 of those before."""
    return len(frame) > 2 and crc16(frame[:-2]) == int.from_bytes(frame[-2:], "big")


def decode_blocks(frames: list[bytes], numbers: list[int]) -> np.ndarray:
    """The samples of frames, a row each, after their CRC-8, CRC-16 and numbers are verified."""
    n = len(frames)
    sizes = np.array([len(f) for f in frames])
    rows = np.zeros((n, int(sizes.max(initial=0)) + 8), np.uint8)
    for i, f in enumerate(frames):
        rows[i, : len(f)] = np.frombuffer(f, np.uint8)
    span = np.arange(n)
    crc = _crcs(rows, sizes - 2, 16)
    if (crc != (rows[span, sizes - 2].astype(np.uint32) << 8 | rows[span, sizes - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    heads = np.empty(n, np.int64)
    for i, (f, k) in enumerate(zip(frames, numbers, strict=True)):
        number, end = read_number(f, 4)
        if f[:2] != b"\xff\xf8" or number != k or crc8(f[:end]) != f[end]:
            raise ValueError(f"the header of frame {k} is damaged")
        heads[i] = end + 1
    kind = rows[span, heads] >> 1 & 0x3F
    x = np.zeros((n, BLOCK), np.int32)
    constant = np.flatnonzero(kind == 0)
    x[constant] = rows[constant, heads[constant] + 1].view(np.int8)[:, None]
    verbatim = np.flatnonzero(kind == 1)
    if len(verbatim):
        x[verbatim] = rows[verbatim[:, None], heads[verbatim][:, None] + 1 + np.arange(BLOCK)].view(np.int8)
    order = kind.astype(np.int64) - 8
    after = heads + 1 + np.clip(order, 0, 4)  # the residual's method and partition order: six zero bits
    fixed = (order >= 0) & (order <= 4) & (rows[span, after] >> 2 == 0) & (rows[span, heads] & 0x81 == 0)
    for i in np.flatnonzero((kind > 1) & ~fixed | (rows[span, heads] & 0x81 != 0)).tolist():
        _, samples, _ = flac_frames.read(frames[i], 0, (BLOCK, BLOCK), 8)
        x[i] = samples[:, 0]
    for k in range(5):
        own = np.flatnonzero(fixed & (order == k))
        if len(own):
            x[own] = _fixed(rows[own], heads[own], k)
    return x.astype(np.int8)


def _fixed(rows: np.ndarray, heads: np.ndarray, order: int) -> np.ndarray:
    n, wide = len(rows), rows.shape[1] * 8
    bits = np.unpackbits(rows, axis=1)
    ahead = np.where(bits == 1, np.arange(wide, dtype=np.int32), np.int32(wide))
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1].ravel()  # the next 1 from each bit
    raw = np.ascontiguousarray(rows).ravel().astype(np.uint32)
    span = np.arange(n)
    base = span * rows.shape[1]
    warm = np.stack([rows[span, heads + 1 + j].view(np.int8) for j in range(order)], axis=1).astype(np.int32) if order else np.zeros((n, 0), np.int32)
    at = (heads + 1 + order) * 8
    byte = base + at // 8  # 2 bits method, 4 bits partition order, 4 bits Rice parameter
    word = raw[byte] << 8 | raw[byte + 1]
    rice = (word >> 6 & 15).astype(np.int64)
    pos, left = at + 10, span * wide
    r = np.empty((n, BLOCK - order), np.int32)
    mask = (1 << rice) - 1
    for i in range(BLOCK - order):
        one = ahead[left + pos].astype(np.int64)
        low = one + 1
        byte = base + (low >> 3)
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        u = ((one - pos) << rice) | ((window >> (24 - (low & 7) - rice)) & mask)
        r[:, i] = (u >> 1) ^ -(u & 1)
        pos = low + rice
    level = r
    for k in range(order, 0, -1):  # undo the differences: a running sum from the first value
        first = np.diff(warm, n=k - 1, axis=1)[:, :1]
        level = np.concatenate([first, first + np.cumsum(level, axis=1)], axis=1)
    return level


def seek(stream: bytes, sample: int) -> tuple[int, int]:
    """The nearest seek point at or before ``sample``: its sample and its byte in the stream."""
    meta = flac_frames.parse(stream)
    if not 0 <= sample < meta.total:
        raise ValueError("beyond the stream")
    first, at = max([(0, 0), *(s for s in meta.seeks if s[0] <= sample)])
    return first, meta.begin + at


def read(stream: bytes, sample: int, count: int) -> bytes:
    """The PCM of at most ``count`` samples from ``sample`` on; only frames from the nearest seek point are decoded."""
    meta = flac_frames.parse(stream)
    wide = meta.channels * -(-meta.bits // 8)
    first, at = seek(stream, sample)
    out = b""
    for _, pcm, _ in flac_frames.frames(stream, meta, at):
        out += pcm
        if len(out) >= (sample - first + count) * wide:
            break
    return out[(sample - first) * wide : (sample - first + count) * wide]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


MAX_BYTES = 2 << 20


def _chunks(sizes: list[int], most: int = MAX_BYTES):
    """Ranges of rows of at most ``most`` bytes, or of one row."""
    a, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield a, i
            a, total = i, 0
        total += s
    if sizes:
        yield a, len(sizes)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: the stored form of each text."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _chunks([4 * len(t or "") for t in texts]):
                made = [payload_of(t) for t in texts[lo:hi]]
                media = encode([p for _, p in made])
                cols = [b.column(0).slice(lo, hi - lo), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``id, sample_offset, byte_offset, pcm``: the decoded samples in blocks that begin at the stream's seek points.

    ``byte_offset`` is where the block's first frame begins in the stream.  A stream without seek points
    gives a block for each frame; null streams give none.
    """

    def run(batches):
        for b in batches:
            media = b.column(1).to_pylist()
            for lo, hi in _chunks([len(m or b"") for m in media]):
                own = [i for i in range(lo, hi) if media[i] is not None]
                rows: list[tuple] = []
                size = 0
                for o, sample, at, pcm in pieces([media[i] for i in own]):
                    rows.append((own[o], sample, at, pcm))
                    size += len(pcm)
                    if size >= MAX_BYTES:
                        yield batch(b, rows)
                        rows, size = [], 0
                yield batch(b, rows)

    def batch(b, rows):
        kinds = (pa.int64(), pa.int64(), pa.binary())
        cols = [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]
        ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *cols], names=["id", "sample_offset", "byte_offset", "pcm"])

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(run, f"id {kind}, sample_offset long, byte_offset long, pcm binary")


class Described:
    """What is kept of a stream while its PCM blocks pass: digests, and level, crossings and range of its samples."""

    def __init__(self):
        self.sha, self.n, self.squares, self.crossings, self.low, self.high = hashlib.sha256(), 0, 0, 0, 127, -128
        self.last, self.tail, self.points = None, b"", []

    def add(self, sample: int, at: int, pcm: bytes) -> None:
        self.sha.update(pcm)
        x = (np.frombuffer(pcm, np.uint8) ^ 0x80).view(np.int8)
        up = x >= 0
        self.crossings += int((up[1:] != up[:-1]).sum()) + int(self.last is not None and bool(up[0]) != self.last)
        self.last = bool(up[-1])
        self.squares += int((x.astype(np.int32) ** 2).sum())
        self.low, self.high = min(self.low, int(x.min())), max(self.high, int(x.max()))
        self.n += len(x)
        self.tail = (self.tail + pcm[-32:])[-32:]
        self.points.append(f"{sample}:{at}")

    def feature(self) -> str:
        rms = int(np.sqrt(self.squares / self.n) * 1000)
        return f"rms={rms};zcr={self.crossings};min={self.low};max={self.high};blocks={self.n // BLOCK}"


def described(media: DataFrame) -> DataFrame:
    """The stored bytes read back block by block: sizes, digests, a feature string and the seekable offsets (sample:byte) of every row."""

    def run(batches):
        for b in batches:
            stored, n_bytes = b.column(2).to_pylist(), b.column(1)
            for lo, hi in _chunks([len(m) for m in stored]):
                found = [Described() for _ in range(lo, hi)]
                for o, sample, at, pcm in pieces(stored[lo:hi]):
                    found[o].add(sample, at, pcm)
                rows = [
                    (d.n, d.sha.hexdigest(), zlib.crc32(d.tail), len(m), hashlib.sha256(m).hexdigest(), d.feature(), ",".join(d.points))
                    for m, d in zip(stored[lo:hi], found, strict=True)
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), n_bytes.slice(lo, hi - lo), *cols], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek_points"]
    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_points string",
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op9."""
    return described(with_media(docs))
