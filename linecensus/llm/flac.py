"""FLAC media columns: payloads as losslessly coded 8-bit samples, decoded frame by frame.

The coder writes mono 8-bit streams of 576-sample blocks: STREAMINFO with the MD5 of the
samples, a seek table with the sample number and byte offset of every frame, and frames
with a constant, verbatim, fixed (order 0 to 2) or linear-prediction (order 2) subframe,
whichever is shortest, with Rice-coded residuals. The decoder takes any mono 8-bit stream
of such a block size: all fixed and linear orders, Rice methods 0 and 1, partitions and
escapes. It verifies each header's CRC-8 and each frame's CRC-16 and, at the end, the MD5;
any mismatch raises. Both work on thousands of frames at once, in steps of LANES frames,
since the seek table makes frames independent; a stream without one is decoded in order.
PCM blocks carry the sample offset they begin at; `seek` decodes only the frames around one.

Defined results: a null text is the empty payload, which is one block of bytes 255; equal
payloads have equal streams. Repeated rows each give a row, a null id stays null. A text of
any length is coded whole; of the codings of a frame the first of the shortest is taken.
What is in memory beyond the payload and its stream is LANES frames at a time. Columns
other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, save

BLOCK = 576
LANES = 2048
PCM = 64 * BLOCK  # samples of a PCM block
#: How the media column is written. Text is poor audio: its streams are nearly as long as itself, and the file
#: format's compression finds the copies that a coder of single streams cannot.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(16 << 20), "parquet.enable.dictionary": "false"}
RATE = 8000
PRECISION, SHIFT = 10, 7  # of the coder's linear predictor


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        out = np.where(out >> np.uint32(bits - 1), (out << np.uint32(1)) ^ np.uint32(poly), out << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Of parts of data (uint8), side by side."""
    order = np.argsort(-length, kind="stable")
    at, n = start[order], length[order]
    crc, alive = np.zeros(len(at), np.uint32), len(at)
    mask, top = np.uint32((1 << bits) - 1), np.uint32(bits - 8)
    for k in range(int(n[0]) if len(n) else 0):
        while n[alive - 1] <= k:
            alive -= 1
        c = crc[:alive]
        crc[:alive] = (((c << np.uint32(8)) & mask) if bits > 8 else 0) ^ table[(c >> top) ^ data[at[:alive] + k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def _number(numbers: np.ndarray) -> list[bytes]:
    """Frame numbers in the extended UTF-8 coding."""
    out = []
    for v in numbers.tolist():
        if v < 0x80:
            out.append(bytes([v]))
            continue
        n = next(k for k in range(2, 8) if v < 1 << (5 * k + 1))
        tail = bytes(0x80 | (v >> 6 * j) & 0x3F for j in range(n - 2, -1, -1))
        out.append(bytes([(0xFF << (8 - n)) & 0xFF | v >> 6 * (n - 1)]) + tail)
    return out


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded frames of (rows, 576) int32 samples: all bytes, and the length of each."""
    m = len(x)
    d1, d2 = np.diff(x, axis=1), np.diff(x, 2, axis=1)
    # least squares for x[n] from x[n-1], x[n-2]
    f = x.astype(np.float32)
    a, b, y = f[:, 1:-1], f[:, :-2], f[:, 2:]
    aa, bb, ab, ay, by = ((p * q).sum(axis=1) for p, q in ((a, a), (b, b), (a, b), (a, y), (b, y)))
    det = np.where(np.abs(aa * bb - ab * ab) < 1e-3 * np.maximum(1, aa * bb), np.inf, aa * bb - ab * ab)
    most = (1 << (PRECISION - 1)) - 1
    c = np.clip(np.rint(np.stack([(ay * bb - by * ab) / det, (by * aa - ay * ab) / det]) * (1 << SHIFT)), -most, most).astype(np.int32)
    lpc = x[:, 2:] - ((c[0][:, None] * x[:, 1:-1] + c[1][:, None] * x[:, :-2]) >> SHIFT)
    choices, bits, ks = [x, d1, d2, lpc], [], []
    for order, r in zip((0, 1, 2, 2), choices):
        u = _zigzag(r)
        k = np.clip(np.floor(np.log2(np.maximum(1, u.mean(axis=1) * 0.7))), 0, 14).astype(np.int32)
        n = (u >> k[:, None]).sum(axis=1) + r.shape[1] * (k + 1) + 10 + 8 * order
        bits.append(n + (9 + 2 * PRECISION if order == 2 and r is lpc else 0))
        ks.append(k)
    bits.append(np.full(m, 8 * BLOCK))  # verbatim
    bits.append(np.where((d1 == 0).all(axis=1), 8, 1 << 30))  # constant
    bits = np.stack(bits)
    kind = bits.argmin(axis=0)
    heads = [b"\xff\xf8\x24\x02" + v for v in _number(numbers)]
    head = np.array([len(h) for h in heads])
    length = head + 1 + (8 + bits[kind, np.arange(m)] + 7) // 8 + 2
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()) * 8, np.uint8)  # bits

    def put(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for j in range(n):
            out[at + j] = (value >> (n - 1 - j)) & 1

    body = (start + head + 1) * 8
    types = np.array([8, 9, 10, 33, 1, 0])
    put(body, types[kind] << 1, 8)
    body = body + 8
    for which, (order, r, k) in enumerate(zip((0, 1, 2, 2), choices, ks)):
        rows = np.flatnonzero(kind == which)
        if not len(rows):
            continue
        at, k = body[rows], k[rows]
        for j in range(order):
            put(at, x[rows, j] & 0xFF, 8)
            at = at + 8
        if which == 3:
            put(at, np.full(len(rows), (PRECISION - 1) << 5 | SHIFT), 9)
            put(at + 9, c[0][rows] & ((1 << PRECISION) - 1), PRECISION)
            put(at + 9 + PRECISION, c[1][rows] & ((1 << PRECISION) - 1), PRECISION)
            at = at + 9 + 2 * PRECISION
        put(at + 6, k, 4)  # method 0, one partition
        u = _zigzag(r[rows])
        q = u >> k[:, None]
        size = q + 1 + k[:, None]
        stop = (at + 10)[:, None] + np.cumsum(size, axis=1) - 1  # last bit of each code
        out[stop - k[:, None]] = 1
        for j in range(int(k.max())):
            some = np.flatnonzero(k > j)
            out[stop[some] - j] = (u[some] >> j) & 1
    rows = np.flatnonzero(kind == 4)
    data = np.packbits(out)
    if len(rows):
        at = body[rows] // 8
        data[at[:, None] + np.arange(BLOCK)] = (x[rows] & 0xFF).astype(np.uint8)
    rows = np.flatnonzero(kind == 5)
    data[body[rows] // 8] = (x[rows, 0] & 0xFF).astype(np.uint8)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(head) - head, head)
    data[np.repeat(start, head) + within] = flat
    data[start + head] = _crc(data, start, head, CRC8, 8)
    crc = _crc(data, start, length - 2, CRC16, 16)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 0xFF
    return data, length


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each of a positive multiple of 576 bytes."""
    counts = [len(p) // BLOCK for p in payloads]
    parts: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    todo = [(d, a, min(LANES, n - a)) for d, n in enumerate(counts) for a in range(0, n, LANES)]
    while todo:
        step, lanes = [], 0
        while todo and (not step or lanes + todo[0][2] <= LANES):
            step.append(todo.pop(0))
            lanes += step[-1][2]
        raw = b"".join(payloads[d][a * BLOCK : (a + n) * BLOCK] for d, a, n in step)
        x = (np.frombuffer(raw, np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
        data, length = _frames(x, np.concatenate([np.arange(a, a + n) for _, a, n in step]))
        stops, k = np.cumsum(length), 0
        for d, _, n in step:
            begin = int(stops[k - 1]) if k else 0
            parts[d].append(data[begin : int(stops[k + n - 1])].tobytes())
            sizes[d].append(length[k : k + n])
            k += n
    out = []
    for p, n, body, size in zip(payloads, counts, parts, sizes):
        size = np.concatenate(size)
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        blocks = b"\x00" + len(info).to_bytes(3, "big") + info
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        points["sample"], points["offset"], points["count"] = np.arange(n) * BLOCK, np.cumsum(size) - size, BLOCK
        most = ((1 << 24) - 1) // 18  # of one metadata block
        tables = [points[a : a + most].tobytes() for a in range(0, n, most)]
        for k, t in enumerate(tables):
            blocks += bytes([3 | 0x80 * (k == len(tables) - 1)]) + len(t).to_bytes(3, "big") + t
        out.append(b"fLaC" + blocks + b"".join(body))
    return out


class Stream:
    """What a stream's metadata says: total samples, MD5, where frames start, seek points (sample, byte)."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points = 4, False, []
        while not last:
            last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + n]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.low, self.high = struct.unpack(">HH", block[:4])
                self.rate, self.channels, self.bits, self.total, self.md5 = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                points.append(np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])))
            at += 4 + n
        self.first = at
        found = np.concatenate(points) if points else np.zeros(0, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        found = found[found["sample"] != 2**64 - 1]
        self.samples, self.offsets = found["sample"].astype(np.int64), found["offset"].astype(np.int64) + at
        if self.channels != 1 or self.bits != 8 or self.low != BLOCK or self.high != BLOCK or self.total % BLOCK:
            raise ValueError("only mono 8-bit streams of whole 576-sample blocks")

    @property
    def indexed(self) -> bool:
        return len(self.samples) == self.total // BLOCK and bool((self.samples == np.arange(len(self.samples)) * BLOCK).all())


def _signed(v: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return v - ((v >> (n - 1)) << n) if np.isscalar(n) else np.where(n > 0, v - ((v >> np.maximum(n - 1, 0)) << n), 0)


def _decode_frames(data: np.ndarray, start: np.ndarray, stop: np.ndarray | None, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (rows, 576) of frames that start at these bytes, and where they end. data has 8 spare bytes."""
    m = len(start)
    lead = data[start + 4].astype(np.int64)
    more = np.where(lead < 0x80, 0, 7 - np.floor(np.log2(np.maximum(1, 255 - lead))).astype(np.int64) - 1)
    value = np.where(more == 0, lead, lead & ((1 << np.maximum(0, 6 - more)) - 1))
    for j in range(1, 7):
        value = np.where(more >= j, value << 6 | data[np.minimum(start + 4 + j, len(data) - 1)] & 0x3F, value)
    head = 5 + more
    fixed = (data[start] == 0xFF) & (data[start + 1] == 0xF8) & (data[start + 2] >> 4 == 2) & (data[start + 3] >> 4 == 0) & (value == numbers)
    if not fixed.all() or (_crc(data, start, head, CRC8, 8) != data[start + head]).any():
        raise ValueError("a frame header is damaged")
    words = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    bits = np.unpackbits(data)
    index = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    following = np.minimum.accumulate(index[::-1])[::-1]
    del bits, index

    def take(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return ((words[at >> 3] << (at & 7).astype(np.uint32)).astype(np.int64) & 0xFFFFFFFF) >> (32 - n)

    body = (start + head + 1) * 8
    kind = data[start + head + 1].astype(np.int64)
    if (kind & 0x81).any():
        raise ValueError("a subframe header is damaged or has wasted bits")
    kind >>= 1
    body = body + 8
    out, end = np.zeros((m, BLOCK), np.int32), np.zeros(m, np.int64)
    for what in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == what)
        at = body[rows]
        if what == 0:
            out[rows] = _signed(take(at, 8), 8)[:, None]
            end[rows] = at + 8
            continue
        if what == 1:
            out[rows] = data[(at >> 3)[:, None] + np.arange(BLOCK)].view(np.int8)
            end[rows] = at + 8 * BLOCK
            continue
        if not (8 <= what <= 12 or what >= 32):
            raise ValueError("a reserved subframe type")
        order = what - 8 if what < 32 else what - 31
        x = np.zeros((BLOCK, len(rows)), np.int64)
        for j in range(order):
            x[j] = _signed(take(at, 8), 8)
            at = at + 8
        if what < 32:
            shift = np.zeros(len(rows), np.int64)
            factors = [np.full(len(rows), c) for c in ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order]]
        else:
            precision, shift = take(at, 4) + 1, _signed(take(at + 4, 5), 5)
            at, factors = at + 9, []
            for _ in range(order):
                factors.append(_signed(take(at, precision), precision))
                at = at + precision
        wide = np.where(take(at, 2) == 1, 5, 4)
        part = BLOCK >> take(at + 2, 4)
        at = at + 6
        sizes = np.unique(part).tolist()
        k, raw = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for i in range(order, BLOCK):
            if i == order or any(i % s == 0 for s in sizes):
                new = np.flatnonzero((i % part == 0) | (i == order))
                p = take(at[new], wide[new])
                escape = p == (1 << wide[new]) - 1
                k[new], raw[new] = np.where(escape, take(at[new] + wide[new], 5), p), escape
                at[new] += wide[new] + 5 * escape
                mask = (np.int64(1) << k) - 1
                odd = bool(raw.any())
            one = following[at].astype(np.int64)
            low = one + 1
            u = (one - at) << k | (words[low >> 3].astype(np.int64) >> np.maximum(0, 32 - (low & 7) - k)) & mask
            r = (u >> 1) ^ -(u & 1)
            new_at = low + k
            if odd:
                r = np.where(raw, _signed(take(at, np.maximum(k, 1)), k), r)
                new_at = np.where(raw, at + k, new_at)
            at = new_at
            if order:
                guess = factors[0] * x[i - 1]
                for j in range(1, order):
                    guess = guess + factors[j] * x[i - 1 - j]
                r = r + (guess >> shift)
            x[i] = r
        out[rows] = x.T
        end[rows] = at
    end = (end + 7) // 8 + 2
    if stop is not None and (end != stop).any():
        raise ValueError("a frame has another length than the seek table says")
    crc = _crc(data, start, end - start - 2, CRC16, 16)
    if (crc != (data[end - 2].astype(np.uint32) << 8 | data[end - 1])).any():
        raise ValueError("a frame's checksum differs")
    if ((out < -128) | (out > 127)).any():
        raise ValueError("a sample is out of range")
    return out, end


def pcm(streams: list[bytes], samples: int = PCM) -> Iterator[tuple[int, int, bytes]]:
    """(stream, sample offset, unsigned samples): PCM blocks in order, LANES frames decoded at a time; raises where a checksum differs."""
    known = [Stream(s) for s in streams]
    held, at, sums = bytearray(), 0, hashlib.md5()

    def frames() -> Iterator[tuple[int, bytes]]:
        """(stream, decoded frames), stream by stream."""
        todo, d = [], 0
        while d < len(known):
            s = known[d]
            if s.indexed:
                todo += [(d, a, min(LANES, len(s.samples) - a)) for a in range(0, len(s.samples), LANES)]
            d += 1
            while todo and (d == len(known) or not known[d].indexed or sum(n for _, _, n in todo) >= LANES):
                step = [todo.pop(0)]
                while todo and sum(n for _, _, n in step) + todo[0][2] <= LANES:
                    step.append(todo.pop(0))
                yield from _decoded(streams, known, step)
            if not s.indexed:
                at, k = s.first, 0
                while k < s.total // BLOCK:
                    data = np.frombuffer(streams[d - 1][at : at + 4 * BLOCK + 64] + bytes(8), np.uint8)
                    x, end = _decode_frames(data, np.zeros(1, np.int64), None, np.array([k]))
                    yield d - 1, (x + 128).astype(np.uint8).tobytes()
                    at, k = at + int(end[0]), k + 1

    for d, part in frames():
        held += part
        sums.update((np.frombuffer(part, np.uint8) ^ 0x80).tobytes())
        ends = at + len(held) >= known[d].total
        while len(held) >= samples or ends and held:
            block = bytes(held[:samples])
            del held[:samples]
            yield d, at, block
            at += len(block)
        if ends:
            if at != known[d].total or sums.digest() != known[d].md5:
                raise ValueError("the samples' MD5 differs")
            at, sums = 0, hashlib.md5()


def _decoded(streams: list[bytes], known: list[Stream], step: list[tuple[int, int, int]]) -> Iterator[tuple[int, bytes]]:
    """step: (stream, first frame, frames), found by the seek tables. Decodes all of them side by side."""
    parts, starts, stops, numbers, base = [], [], [], [], 0
    for d, a, n in step:
        edge = np.append(known[d].offsets[a : a + n + 1], [len(streams[d])] if a + n == len(known[d].offsets) else [])
        parts.append(streams[d][int(edge[0]) : int(edge[n])])
        starts.append(edge[:n] - edge[0] + base)
        stops.append(edge[1 : n + 1] - edge[0] + base)
        numbers.append(np.arange(a, a + n))
        base += len(parts[-1])
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    x, _ = _decode_frames(data, *(np.concatenate(v).astype(np.int64) for v in (starts, stops, numbers)))
    flat, k = (x + 128).astype(np.uint8), 0
    for d, _, n in step:
        yield d, flat[k : k + n].tobytes()
        k += n


def seek(stream: bytes, offset: int, samples: int) -> bytes:
    """The samples from an offset on, read from the frames that hold them; the seek table says where those are."""
    known = Stream(stream)
    if not known.indexed:
        raise ValueError("a stream without a full seek table cannot be sought")
    stop = min(known.total, offset + samples)
    if not 0 <= offset < stop:
        return b""
    first, last = offset // BLOCK, (stop - 1) // BLOCK
    steps = [(0, a, min(LANES, last + 1 - a)) for a in range(first, last + 1, LANES)]
    whole = b"".join(part for step in steps for _, part in _decoded([stream], [known], [step]))
    return whole[offset - first * BLOCK : stop - first * BLOCK]


def decode(streams: list[bytes]) -> list[bytes]:
    """Payloads of FLAC streams; raises where a checksum differs."""
    out: list[list[bytes]] = [[] for _ in streams]
    for d, _, block in pcm(streams):
        out[d].append(block)
    return [b"".join(p) for p in out]


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a FLAC stream of the padded UTF-8 text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _bounded(b, 1):
                raw = [(t.as_py() or "").encode() for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode([padded(r) for r in raw]), pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, media binary")


def _bounded(b: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in a column."""
    sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in b.column(column)]
    a, total = 0, 0
    for k, n in enumerate(sizes):
        if k > a and total + n > most:
            yield b.slice(a, k - a)
            a, total = k, 0
        total += n
    if a < len(sizes):
        yield b.slice(a)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """to_media, written to the shared folder: what reads it reads stored bytes."""
    return save(to_media(docs, id_col, text_col), "media", **STORED)


def pcm_blocks(media: DataFrame, samples: int = PCM) -> DataFrame:
    """doc_id, sample_offset, pcm (unsigned 8-bit): blocks of decoded samples that can be sought by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _bounded(b, 1):
                ids = part.column(0).to_pylist()
                for d, at, block in pcm(part.column(1).to_pylist(), samples):
                    yield pa.record_batch([pa.array([ids[d]], pa.int64()), pa.array([at], pa.int64()), pa.array([block], pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return map_arrow(media.select("doc_id", "media"), run, "doc_id long, sample_offset long, pcm binary")


class _Payload:
    """Sizes, digests and whole-number statistics of samples (mean, mean square, zero crossings, largest size), block by block."""

    def __init__(self) -> None:
        self.n, self.sha, self.tail = 0, hashlib.sha256(), b""
        self.total = self.square = self.crossings = self.peak = 0
        self.last: bool | None = None

    def add(self, block: bytes) -> None:
        x = np.frombuffer(block, np.uint8).astype(np.int64) - 128
        below = x < 0
        self.n, self.tail = self.n + len(x), (self.tail + block)[-32:]
        self.sha.update(block)
        self.total, self.square, self.peak = self.total + int(x.sum()), self.square + int((x * x).sum()), max(self.peak, int(np.abs(x).max()))
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.last is not None and self.last != bool(below[0]))
        self.last = bool(below[-1])

    @property
    def feature(self) -> str:
        return f"mean={self.total * 1000 // self.n};power={self.square // self.n};crossings={self.crossings};peak={self.peak}"


def digests(media: DataFrame) -> DataFrame:
    """media: doc_id, n_bytes, media. The bytes read back, PCM block by PCM block: sizes, digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for part in _bounded(b, 2):
                stored = part.column(2).to_pylist()
                got = [_Payload() for _ in stored]
                for d, _, block in pcm(stored):
                    got[d].add(block)
                cols = [part.column(0), part.column(1), [p.n for p in got], [p.sha.hexdigest() for p in got], [zlib.crc32(p.tail) for p in got], [len(s) for s in stored], [hashlib.sha256(s).hexdigest() for s in stored], [p.feature for p in got]]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, ddl)
