"""FLAC: a lossless encoder for mono PCM and decoders that verify what they read.

``encode_many`` and ``decode_many`` work on many streams at once: step i of a frame is done
for all frames together, so numpy's cost a step is shared by some thousand frames.
``decode_stream`` reads any FLAC stream of one or two channels frame by frame.

Layout of the format (public: RFC 9639): "fLaC", metadata blocks (stream information with
the MD5 of the samples, seek table), then frames: a header with CRC-8, one subframe a
channel (constant, verbatim, fixed or linear prediction with Rice-coded residuals), CRC-16.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 1024
#: Frames that are coded together; bounds the memory for texts of any length.
GROUP = 2048
#: Coefficients of the fixed predictors of order 0 to 4, latest sample first. Fixed values.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: The encoder's own linear predictor: the mean of the last 8 samples, shifted by 3.
MEAN = ((1,) * 8, 3)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = ((x << 1) ^ (poly if x & top else 0)) & mask
        out.append(x)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = int(_CRC8[x ^ b])
    return x


def crc16_many(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-16 of ``data[start : start + size]`` for each of many runs of bytes."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    out = np.zeros(len(order), np.int64)
    live = len(order)
    for i in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= i:
            live -= 1
        x = out[:live]
        out[:live] = ((x << 8) & 0xFFFF) ^ _CRC16[(x >> 8) ^ data[at[:live] + i]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _coded_number(n: int) -> bytes:
    """A frame's number, coded like a UTF-8 character (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= (1 << (6 - len(tail))):
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    """A frame of ``size`` samples: fixed block size, rate and 8 bits as in the stream
    information, mono."""
    if size == BLOCK:
        code, extra = 10, b""  # 256 * 2 ** (10 - 8)
    else:
        code, extra = 7, struct.pack(">H", size - 1)
    head = bytes([0xFF, 0xF8, code << 4, 1 << 1]) + _coded_number(number) + extra
    return head + bytes([crc8(head)])


def _residuals(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(order, residuals) of each candidate predictor for rows of samples."""
    mean = np.zeros_like(x)
    sums = np.cumsum(x, axis=1)
    if x.shape[1] > 8:
        mean[:, 8:] = sums[:, 7:-1]
        mean[:, 9:] -= sums[:, : -9]
    return [(0, x), (1, np.diff(x, axis=1, prepend=0)), (8, x - (mean >> 3))]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload of unsigned 8-bit samples as a FLAC stream with a seek table that has
    every frame. Payloads must not be empty."""
    sizes = [len(p) for p in payloads]
    counts = [-(-n // BLOCK) for n in sizes]
    frames = sum(counts)
    raw = np.zeros(frames * BLOCK, np.uint8)
    size, number, at = np.full(frames, BLOCK, np.int64), np.empty(frames, np.int64), 0
    for p, n, c in zip(payloads, sizes, counts, strict=True):
        raw[at * BLOCK : at * BLOCK + n] = np.frombuffer(p, np.uint8)
        number[at : at + c] = np.arange(c)
        size[at + c - 1] = n - (c - 1) * BLOCK
        at += c
    groups = [_encode_frames(raw[BLOCK * lo : BLOCK * (lo + GROUP)], number[lo : lo + GROUP], size[lo : lo + GROUP]) for lo in range(0, frames, GROUP)]
    data, frame_bytes = (np.concatenate(x) for x in zip(*groups, strict=True))
    frame_at = np.concatenate(([0], np.cumsum(frame_bytes)))
    out, at = [], 0
    for p, n, c in zip(payloads, sizes, counts, strict=True):
        own = slice(at, at + c)
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        block = BLOCK if c > 1 else n
        info = struct.pack(">HH", max(16, block), max(16, block)) + int(frame_bytes[own].min()).to_bytes(3, "big") + int(frame_bytes[own].max()).to_bytes(3, "big")
        info += ((8000 << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
        table = np.empty(c, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
        table["s"], table["o"], table["n"] = number[own] * BLOCK, frame_at[own] - frame_at[at], size[own]
        seek = table.tobytes()
        blocks = [(0, info), *((3, seek[i : i + 18 * 900_000]) for i in range(0, len(seek), 18 * 900_000))]
        meta = b"".join(struct.pack(">I", len(b) | ((kind_ | (0x80 if i == len(blocks) - 1 else 0)) << 24)) + b for i, (kind_, b) in enumerate(blocks))
        out.append(b"fLaC" + meta + data[frame_at[at] : frame_at[at + c]].tobytes())
        at += c
    return out

def _encode_frames(raw: np.ndarray, number: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the frames one after another, and the size of each."""
    frames = len(size)
    x = (raw.astype(np.int32) - 128).reshape(frames, BLOCK)
    inside = np.arange(BLOCK) < size[:, None]
    least, kind, rice = np.full(frames, 1 << 60, np.int64), np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    folded = np.zeros((frames, BLOCK), np.int32)
    for order, res in _residuals(x):
        z = (res << 1) ^ (res >> 31)
        z[:, :order] = 0
        z[~inside] = 0
        total = z.sum(axis=1, dtype=np.int64)
        scaled = total * size // np.maximum(size - order, 1)  # by the mean residual
        better = (scaled < least) & (size > order)
        least[better], kind[better] = scaled[better], order
        folded[better] = z[better]
    mean = np.maximum(least // size, 1)
    guess = np.clip(np.floor(np.log2(mean * 0.7 + 0.5)).astype(np.int64), 1, 7)
    best = np.full(frames, 1 << 60, np.int64)
    for k in (guess, np.minimum(guess + 1, 8)):
        cost = (folded >> k.astype(np.int32)[:, None]).sum(axis=1, dtype=np.int64) + (size - kind) * (1 + k)
        rice = np.where(cost < best, k, rice)
        best = np.minimum(cost, best)
    coded = inside & (np.arange(BLOCK) >= kind[:, None])
    width = np.where(coded, (folded >> rice.astype(np.int32)[:, None]) + 1 + rice[:, None], 0)
    heads = [_frame_header(n, s) for n, s in zip(number.tolist(), size.tolist(), strict=True)]
    head_bits = np.array([8 * len(h) for h in heads], np.int64)
    # subframe type, warm-up samples, for the mean predictor precision (2 bits) - 1, shift and coefficients, then
    # the Rice method, partition order 0 and the parameter
    intro = 8 + 8 * kind + np.where(kind == 8, 4 + 5 + 8 * 2, 0) + 2 + 4 + 4
    body = head_bits + intro + width.sum(axis=1)
    frame_bytes = (body + 7) // 8 + 2
    frame_at = np.concatenate(([0], np.cumsum(frame_bytes)))
    bits = np.zeros(int(frame_at[-1]) * 8, np.uint8)
    first = frame_at[:-1] * 8 + head_bits

    def put(where: np.ndarray, values: np.ndarray, count: int) -> None:
        for j in range(count):
            bits[where + j] = (values >> (count - 1 - j)) & 1

    put(first, np.where(kind == 8, 0b01001110, np.where(kind == 1, 0b00010010, 0b00010000)), 8)  # types 32 + order - 1, 8 + order
    cursor = first + 8
    for i in range(8):
        own = kind > i
        put(cursor[own], x[own, i] & 0xFF, 8)
        cursor[own] += 8
    own = kind == 8
    put(cursor[own], np.full(own.sum(), 1), 4)  # precision 2
    put(cursor[own] + 4, np.full(own.sum(), MEAN[1]), 5)
    for i in range(8):
        put(cursor[own] + 9 + 2 * i, np.full(own.sum(), 1), 2)
    cursor[own] += 25
    put(cursor, rice, 10)  # method 00, order 0000, parameter
    cursor += 10
    stops = cursor[:, None] + np.cumsum(width, axis=1) - rice[:, None] - 1
    bits[stops[coded]] = 1
    for k in np.unique(rice).tolist():
        own = coded & (rice == k)[:, None]
        z, stop = folded[own], stops[own]
        for j in range(k):
            bits[stop + (k - j)] = (z >> j) & 1
    data = np.packbits(bits)
    for i, h in enumerate(heads):
        data[frame_at[i] : frame_at[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16_many(data, frame_at[:-1], frame_bytes - 2)
    data[frame_at[1:] - 2], data[frame_at[1:] - 1] = crc >> 8, crc & 0xFF
    return data, frame_bytes


def metadata(stream: bytes) -> tuple[dict, np.ndarray, int]:
    """(stream information, seek points as rows of sample, offset, size, start of frames)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last = 4, {}, [], False
    while not last:
        word = struct.unpack(">I", stream[at : at + 4])[0]
        last, kind, n = bool(word >> 31), (word >> 24) & 0x7F, word & 0xFFFFFF
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": ((packed >> 41) & 7) + 1, "bits": ((packed >> 36) & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            points.append(np.frombuffer(body, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")])))
        at += 4 + n
    if not info:
        raise ValueError("no stream information")
    table = np.concatenate(points) if points else np.zeros(0, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
    table = table[table["s"] != (1 << 64) - 1]
    return info, np.stack([table[c].astype(np.int64) for c in "son"], axis=1).reshape(-1, 3), at


class _OtherMake(ValueError):
    """A frame that is not as ``encode_many`` writes it, by intent or by damage."""


class _Windows:
    """Reads up to 25 bits at any bit position of a byte array, for many at once."""

    def __init__(self, data: np.ndarray):
        data = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint32)
        self.words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]

    def read(self, at: np.ndarray, count) -> np.ndarray:
        return ((self.words[at >> 3] << (at & 7).astype(np.uint32)) >> np.asarray(32 - np.asarray(count), np.uint32)).astype(np.int64) if not np.isscalar(count) or count else np.zeros(len(at), np.int64)


def _decode_any(stream: bytes) -> bytes:
    info, samples = decode_stream(stream)
    if info["channels"] != 1 or info["bits"] != 8:
        raise ValueError("not a stream of 8-bit mono samples")
    return (samples[0] + 128).astype(np.uint8).tobytes()


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The unsigned 8-bit samples of streams as ``encode_many`` writes them (mono, 8 bits, a
    seek point for each frame, one Rice partition a frame). Frame checksums, sample counts
    and the MD5 are verified. Streams of other makes go through ``decode_stream``."""
    metas = [metadata(s) for s in streams]
    easy = [m[0]["channels"] == 1 and m[0]["bits"] == 8 and len(m[1]) > 0 and int(m[1][:, 2].sum()) == m[0]["samples"] for m in metas]
    out: list[bytes] = [_decode_any(s) if not ok else b"" for s, ok in zip(streams, easy, strict=True)]
    chosen = [i for i, ok in enumerate(easy) if ok]
    if not chosen:
        return out
    data = np.frombuffer(b"".join(streams[i] for i in chosen), np.uint8)
    base, starts, stops, sizes, numbers = 0, [], [], [], []
    for i in chosen:
        _, points, first = metas[i]
        offsets = base + first + points[:, 1]
        starts.append(offsets)
        stops.append(np.append(offsets[1:], base + len(streams[i])))
        sizes.append(points[:, 2])
        numbers.append(np.arange(len(points)))
        base += len(streams[i])
    start, stop, size, number = (np.concatenate(x) for x in (starts, stops, sizes, numbers))
    cuts = [slice(lo, lo + GROUP) for lo in range(0, len(start), GROUP)]
    try:
        pcm = np.concatenate([_decode_frames(data, start[c], stop[c], size[c], number[c]) for c in cuts])
    except _OtherMake:
        for i in chosen:
            out[i] = _decode_any(streams[i])
        return out
    at_frame = 0
    for i in chosen:
        info, points, _ = metas[i]
        n = len(points)
        rows = pcm[at_frame : at_frame + n]
        full = rows[:-1, :BLOCK].tobytes() + rows[-1, : points[-1, 2]].tobytes() if n > 1 else rows[0, : points[0, 2]].tobytes()
        at_frame += n
        if len(full) != info["samples"] or hashlib.md5((np.frombuffer(full, np.uint8) ^ 0x80).tobytes()).digest() != info["md5"]:
            raise ValueError("the samples do not have the stream's MD5")
        out[i] = full
    return out

def _decode_frames(data: np.ndarray, start: np.ndarray, stop: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A row of samples for each frame; its header, checksums and residuals are read."""
    stored = (data[stop - 2].astype(np.int64) << 8) | data[stop - 1]
    if (crc16_many(data, start, stop - start - 2) != stored).any():
        raise ValueError("a frame's CRC-16 is wrong")
    heads = [_frame_header(n, s) for n, s in zip(number.tolist(), size.tolist(), strict=True)]
    if any(data[a : a + len(h)].tobytes() != h for a, h in zip(start.tolist(), heads, strict=True)):
        raise _OtherMake("a frame's header does not fit its seek point")
    first = int(start.min())
    data, start = data[first : int(stop.max())], start - first
    bits = _Windows(data)
    at = start * 8 + np.array([8 * len(h) for h in heads], np.int64)
    kind = bits.read(at, 8)
    at = at + 8
    order = np.where(kind >= 64, ((kind >> 1) & 31) + 1, (kind >> 1) & 7)
    if not np.isin(kind, (0b01001110, 0b00010010, 0b00010000)).all():
        raise _OtherMake("a subframe is of a type that this decoder leaves to decode_stream")
    width = int(size.max())
    x = np.zeros((len(start), width), np.int64)
    for i in range(int(order.max(initial=0))):
        own = order > i
        value = bits.read(at[own], 8)
        x[own, i] = value - ((value & 0x80) << 1)
        at[own] += 8
    linear = kind >= 64
    precision = bits.read(at[linear], 4) + 1
    shift = bits.read(at[linear] + 4, 5)
    coefs = np.zeros((int(linear.sum()), 8), np.int64)
    where = at[linear] + 9
    for i in range(8 if linear.any() else 0):
        value = bits.read(where, precision)
        coefs[:, i] = value - ((value >> (precision - 1)) << precision)
        where = where + precision
    at[linear] = where
    if len(at) and bits.read(at, 6).any():
        raise _OtherMake("a residual is partitioned; use decode_stream")
    rice = bits.read(at + 6, 4)
    at = at + 10
    residual = np.zeros((len(start), width), np.int64)
    # frames in order of their last step, so that those at work are always the first ones
    rank = np.argsort(-size, kind="stable")
    at, rice, order, size_r = at[rank], rice[rank], order[rank], size[rank]
    res = residual[rank]
    leads = np.array([32] + [32 - int(v).bit_length() for v in range(1, 256)], np.int64)  # leading zeros of a small 32-bit word
    words = bits.words
    live = len(rank)
    for i in range(width):
        while live and size_r[live - 1] <= i:
            live -= 1
        own = slice(0, live) if i >= 8 else np.flatnonzero((order <= i) & (size_r > i))
        p, k = at[own], rice[own]
        word = words[p >> 3] << (p & 7).astype(np.uint32)
        zeros = np.where(word >= 1 << 24, leads[word >> 24] - 24, 25)
        for far in np.flatnonzero(zeros > 7).tolist():  # a long run of zeros: look on byte by byte
            q, n = int(p[far]), 0
            while not (int(words[(q + n) >> 3]) << ((q + n) & 7)) & 0x80000000:
                n += 1
            zeros[far] = n
        p = p + zeros + 1
        low = (((words[p >> 3] << (p & 7).astype(np.uint32)) >> 1) >> (31 - k).astype(np.uint32)).astype(np.int64)
        z = (zeros << k) | low
        res[own, i] = (z >> 1) ^ -(z & 1)
        at[own] = p + k
    residual[rank] = res
    one = kind == 0b00010010
    x[one] = np.cumsum(np.concatenate((x[one, :1], residual[one, 1:]), axis=1), axis=1) if one.any() else x[one]
    plain = kind == 0b00010000
    x[plain] = residual[plain]
    if linear.any():
        s, r = np.ascontiguousarray(x[linear].T), np.ascontiguousarray(residual[linear].T)
        flat = (coefs == 1).all()
        total = s[:8].sum(axis=0)
        for i in range(8, width):
            guess = total if flat else (coefs * s[i - 8 : i][::-1].T).sum(axis=1)
            s[i] = r[i] + (guess >> shift)
            if flat:
                total = total + s[i] - s[i - 8]
        x[linear] = s.T
    out = np.zeros((len(start), BLOCK), np.uint8)
    out[:, :width] = x + 128
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        if hi > len(self.data):
            raise ValueError("the stream ends within a frame")
        word = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def zeros(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _residual(b: _Bits, order: int, size: int) -> list[int]:
    method = b.read(2)
    if method > 1:
        raise ValueError("unknown residual coding")
    width, parts = (5 if method else 4), 1 << b.read(4)
    out = []
    for p in range(parts):
        n, k = size // parts - (order if p == 0 else 0), b.read(width)
        if k == (1 << width) - 1:
            raw = b.read(5)
            out.extend(b.signed(raw) for _ in range(n))
        else:
            for _ in range(n):
                z = (b.zeros() << k) | b.read(k)
                out.append((z >> 1) ^ -(z & 1))
    return out


def _subframe(b: _Bits, size: int, depth: int) -> np.ndarray:
    kind = b.read(8)
    wasted = 0
    if kind & 1:
        wasted = b.zeros() + 1
        depth -= wasted
    kind = (kind >> 1) & 63
    if kind == 0:
        x = [b.signed(depth)] * size
    elif kind == 1:
        x = [b.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        x = [b.signed(depth) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision = b.read(4) + 1
            shift = b.signed(5)
            coefs = tuple(b.signed(precision) for _ in range(order))
        for r in _residual(b, order, size):
            x.append(r + (sum(c * x[-1 - i] for i, c in enumerate(coefs)) >> shift))
    else:
        raise ValueError("reserved subframe type")
    return np.array(x, np.int64) << wasted


def decode_stream(stream: bytes, from_sample: int = 0) -> tuple[dict, list[np.ndarray]]:
    """(stream information, samples of each channel) of a FLAC stream of one or two
    channels, from the frame that holds ``from_sample`` on (found by the seek table where
    there is one). Checksums of headers and frames are verified, and the MD5 if all is read."""
    info, points, first = metadata(stream)
    if info["channels"] > 2:
        raise ValueError("more than two channels")
    ahead = points[points[:, 0] <= from_sample]
    at = first + (int(ahead[-1, 1]) if len(ahead) else 0)
    done, parts = (int(ahead[-1, 0]) if len(ahead) else 0), [[] for _ in range(info["channels"])]
    info = info | {"first_sample": done}
    while at < len(stream) and (not info["samples"] or done < info["samples"]):
        b = _Bits(stream, at)
        if b.read(15) != 0x7FFC:
            raise ValueError("no frame where one should begin")
        b.read(1)
        size_code, rate_code, channels, depth_code = b.read(4), b.read(4), b.read(4), b.read(3)
        b.read(1)
        lead = b.read(8)
        for _ in range(max(0, (~lead & 0xFF ^ 0xFF).bit_length() and (8 - (lead ^ 0xFF).bit_length()) - 1)):
            b.read(8)
        size = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else b.read(8) + 1 if size_code == 6 else b.read(16) + 1 if size_code == 7 else 256 << (size_code - 8)
        b.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        if crc8(stream[at : b.at >> 3]) != b.read(8):
            raise ValueError("a header's CRC-8 is wrong")
        depth = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}[depth_code]
        n = 2 if channels >= 8 else channels + 1
        own = [_subframe(b, size, depth + (channels in (8, 10) and c == 1) + (channels == 9 and c == 0)) for c in range(n)]
        if channels == 8:
            own[1] = own[0] - own[1]
        elif channels == 9:
            own[0] = own[0] + own[1]
        elif channels == 10:
            mid = (own[0] << 1) | (own[1] & 1)
            own = [(mid + own[1]) >> 1, (mid - own[1]) >> 1]
        end = (b.at + 7) >> 3
        body = np.frombuffer(stream[at:end], np.uint8)
        if int(crc16_many(body, np.array([0]), np.array([len(body)]))[0]) != int.from_bytes(stream[end : end + 2], "big"):
            raise ValueError("a frame's CRC-16 is wrong")
        for p, x in zip(parts, own, strict=True):
            p.append(x)
        done += size
        at = end + 2
    samples = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
    if not info["first_sample"] and any(info["md5"]):
        width = (info["bits"] + 7) // 8
        packed = np.stack(samples, axis=1).astype("<i8").tobytes()
        raw = np.frombuffer(packed, np.uint8).reshape(-1, 8)[:, :width].tobytes()
        if hashlib.md5(raw).digest() != info["md5"]:
            raise ValueError("the samples do not have the stream's MD5")
    return info, samples
