"""Media columns: lossless FLAC streams of 8-bit mono samples, written and decoded in numpy.

A payload's bytes are companded: the bytes that are common in text have the samples
of least size, which Rice codes keep short. Frames hold ``BLOCK`` samples (the
last fewer). Each is predicted by the fixed polynomial of order 0 to 2, or by a
linear predictor of order ``LPC`` with quantized coefficients (autocorrelation,
Levinson-Durbin), whichever takes fewer bits; residuals are Rice coded in one
partition. Streams have STREAMINFO with the MD5 of the samples and, beyond one
frame, a SEEKTABLE.

Many frames are coded and decoded side by side: the code of a sample starts where
the last one ended, so the decoder steps along the samples of up to ``FRAMES``
frames at once over a table of the next set bit; linear predictors step along in
the same way. Frames of other writers (several partitions, escapes, verbatim or
constant frames) take a plain bit reader.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changelens.llm.common import map_arrow, table, written

BLOCK, FRAMES, SEEK_EVERY, RATE = 1024, 1024, 16, 8000
PAD = 64
MAX_ORDER, MAX_K = 2, 14
#: Order of linear predictors, bits of a coefficient, and the fewest samples of a frame that may have one.
LPC, PRECISION, LEAST_LPC = 8, 10, 64


# Bytes by how common they are in text, most common first; the others follow in order.
_COMMON = b" etaoinsrhldcumfgpywbvk\xc3,.jxqz-0123456789'\n\"ETAOINSRHLDCUMFGPYWBVK:;()/_=+@#*|<>\x00"


def _companding() -> tuple[np.ndarray, np.ndarray]:
    """Sample of each byte, and byte of each sample (as unsigned): 0, -1, 1, -2 and so on by rank."""
    order = np.array([*_COMMON, *(b for b in range(256) if b not in _COMMON)])
    rank = np.arange(256)
    sample = ((rank >> 1) ^ -(rank & 1)).astype(np.int8)
    to_sample, to_byte = np.empty(256, np.int8), np.empty(256, np.uint8)
    to_sample[order] = sample
    to_byte[sample.view(np.uint8)] = order
    return to_sample, to_byte


TO_SAMPLE, TO_BYTE = _companding()


def samples_of(payload: bytes) -> np.ndarray:
    return TO_SAMPLE[np.frombuffer(payload, np.uint8)]


def payload_from(samples: np.ndarray) -> bytes:
    return TO_BYTE[samples.view(np.uint8)].tobytes()


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16).astype(np.uint16)


class Damaged(ValueError):
    """A checksum, a sync code or a digest does not fit."""


class EndOfBits(Damaged):
    """A frame goes on behind the bytes at hand."""


#: What reading bytes that are no frame may raise: ``Damaged``, negative shifts and short buffers are ValueErrors.
_NO_FRAME = (ValueError, IndexError, OverflowError)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(chunks: list[bytes]) -> np.ndarray:
    """CRC-16 of every chunk. It starts at zero, so chunks are set right behind leading zeros and run side by side."""
    width = max(map(len, chunks), default=0)
    rows = np.frombuffer(b"".join(c.rjust(width, b"\0") for c in chunks), np.uint8).reshape(len(chunks), width).T.astype(np.uint16)
    crc = np.zeros(len(chunks), np.uint16)
    for column in rows:
        crc = crc << 8 ^ _CRC16.take(crc >> 8 ^ column)
    return crc


def _coded_number(n: int) -> bytes:
    """Frame number in the UTF-8 like form of frame headers."""
    if n < 128:
        return bytes([n])
    tail = 1
    while n >> (6 * tail + 6 - tail):
        tail += 1
    head = 0xFF00 >> (tail + 1) & 0xFF | n >> 6 * tail
    return bytes([head, *(0x80 | n >> 6 * i & 0x3F for i in reversed(range(tail)))])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (``PRECISION`` bits), shifts and residuals of linear predictors of the rows of ``x``."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, : f.shape[1] - j] * f[:, j:]).sum(axis=1) for j in range(LPC + 1)], axis=1)
    error, a = r[:, 0] * (1 + 1e-9) + 1e-6, np.zeros((len(x), LPC))
    for i in range(LPC):
        reflect = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= reflect[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = reflect
        error = np.maximum(error * (1 - reflect**2), 1e-6)
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)), 0, 15).astype(np.int32)
    half = 1 << (PRECISION - 1)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -half, half - 1).astype(np.int32)
    guess = np.zeros_like(x)
    for j in range(LPC):
        guess[:, LPC:] += q[:, j, None] * x[:, LPC - 1 - j : x.shape[1] - 1 - j]
    res = x.copy()
    res[:, LPC:] -= guess[:, LPC:] >> shift[:, None]
    return q, shift, res


def _bits_of(values: np.ndarray, width: int) -> np.ndarray:
    """The last ``width`` bits of each value, row by row."""
    return (values[..., None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).reshape(len(values), -1)


def _rice_bits(res: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter and bits of the ``coded`` residuals of every row."""
    u = (res << 1) ^ (res >> 31)
    mean = (u * coded).sum(axis=1) / np.maximum(1, coded.sum(axis=1))
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, MAX_K).astype(np.int32)
    return k, (((u >> k[:, None]) + 1 + k[:, None]) * coded).sum(axis=1)


def _encode_group(samples: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """Frames of up to ``FRAMES`` sample arrays."""
    n = np.array([len(s) for s in samples])
    width = int(n.max())
    x = np.zeros((len(samples), width), np.int32)
    for i, s in enumerate(samples):
        x[i, : len(s)] = s
    inside = np.arange(width) < n[:, None]
    diffs, cost = [x], []
    for order in range(MAX_ORDER + 1):
        if order:
            d = diffs[-1].copy()
            d[:, order:] = diffs[-1][:, order:] - diffs[-1][:, order - 1 : -1]
            diffs.append(d)
        a = np.abs(diffs[order]) * inside
        cost.append(np.where(n > MAX_ORDER, a[:, MAX_ORDER:].sum(axis=1), 0))
    order = np.argmin(np.stack(cost), axis=0)
    res = np.stack(diffs)[order, np.arange(len(samples))]
    k, taken = _rice_bits(res, inside & (np.arange(width) >= order[:, None]))
    linear = np.zeros(len(samples), bool)
    head_bits = np.zeros((len(samples), 0), np.uint8)
    if width >= LEAST_LPC:
        q, shift, residual = _linear(x)
        residual *= inside
        k_linear, taken_linear = _rice_bits(residual, inside & (np.arange(width) >= LPC))
        linear = (n >= LEAST_LPC) & (taken_linear + 9 + LPC * (PRECISION + 8) < taken + 8 * order)
        res, k, order = np.where(linear[:, None], residual, res), np.where(linear, k_linear, k), np.where(linear, LPC, order)
        head_bits = np.concatenate((_bits_of(np.full(len(samples), PRECISION - 1), 4), _bits_of(shift, 5), _bits_of(q, PRECISION)), axis=1)
    coded = inside & (np.arange(width) >= order[:, None])
    u = (res << 1) ^ (res >> 31)
    high = u >> k[:, None]
    length = np.where(coded, high + 1 + k[:, None], 0)
    end = np.cumsum(length, axis=1)
    total = end[:, -1] if width else np.zeros(len(samples), int)
    room = -(-int(total.max()) // 8) * 8
    bits = np.zeros(len(samples) * room, np.uint8)
    stop = (end - length + high + np.arange(len(samples))[:, None] * room)[coded]
    value, each = u[coded], np.broadcast_to(k[:, None], coded.shape)[coded]
    bits[stop] = 1
    for one in np.unique(k):
        at, v = (stop, value) if len(np.unique(k)) == 1 else (stop[each == one], value[each == one])
        for j in range(one):
            bits[at + 1 + j] = v >> (one - 1 - j) & 1
    bits = bits.reshape(len(samples), room)
    # Method 0 and partition order 0, then the parameter.
    rice = np.concatenate((np.zeros((len(samples), 6), np.uint8), _bits_of(k, 4)), axis=1)
    bodies = []
    for i, s in enumerate(samples):
        o = int(order[i])
        head = b"\xff\xf8\x70\x02" + _coded_number(numbers[i]) + (len(s) - 1).to_bytes(2, "big")
        head += bytes([crc8(head)]) + bytes([(31 if linear[i] else 8) + o << 1]) + s[:o].astype(np.int8).tobytes()
        row = np.concatenate((*([head_bits[i]] if linear[i] else []), rice[i], bits[i, : total[i]]))
        bodies.append(head + np.packbits(row).tobytes())
    return [b + int(c).to_bytes(2, "big") for b, c in zip(bodies, crc16(bodies).tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload."""
    samples = list(map(samples_of, payloads))
    cut = [(i, f, p[f * BLOCK : (f + 1) * BLOCK]) for i, p in enumerate(samples) for f in range(-(-len(p) // BLOCK))]
    order = sorted(range(len(cut)), key=lambda j: -len(cut[j][2]))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in samples]
    for at in range(0, len(order), FRAMES):
        group = [cut[j] for j in order[at : at + FRAMES]]
        for (i, f, _), frame in zip(group, _encode_group([s for _, _, s in group], [f for _, f, _ in group]), strict=True):
            frames[i][f] = frame
    return [_stream(p, fs) for p, fs in zip(samples, frames, strict=True)]


def _stream(samples: np.ndarray, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames] or [0]
    md5 = hashlib.md5(samples.tobytes()).digest()
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + md5
    out = [b"fLaC", bytes([0 if len(frames) > 1 else 0x80]), len(info).to_bytes(3, "big"), info]
    if len(frames) > 1:
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
        points = b"".join((f * BLOCK).to_bytes(8, "big") + starts[f].to_bytes(8, "big") + min(BLOCK, len(samples) - f * BLOCK).to_bytes(2, "big") for f in range(0, len(frames), SEEK_EVERY))
        out += [b"\x83", len(points).to_bytes(3, "big"), points]
    return b"".join([*out, *frames])


class _Bits:
    """Plain bit reader for frames that the side-by-side decoder does not know."""

    def __init__(self, data: bytes):
        self.n, self.at, self.size = int.from_bytes(data, "big"), 0, 8 * len(data)

    def take(self, k: int) -> int:
        self.at += k
        if self.at > self.size:
            raise EndOfBits("frame ends early")
        return self.n >> (self.size - self.at) & ((1 << k) - 1)

    def signed(self, k: int) -> int:
        v = self.take(k) if k else 0
        return v - (1 << k) if k and v >> (k - 1) else v

    def unary(self) -> int:
        rest = self.n & ((1 << (self.size - self.at)) - 1)
        if not rest:
            raise EndOfBits("frame ends early")
        q = self.size - self.at - rest.bit_length()
        self.at += q + 1
        return q


#: Coefficients of the fixed predictors.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _decode_one(data: bytes, at: int, n: int, bps: int) -> tuple[np.ndarray, int]:
    """Samples of one mono subframe that starts at byte ``at``, and the byte behind it.

    The reader gets as many bytes as such a subframe seldom passes, and twice as
    many again and again where it does: the rest of a long stream costs nothing.
    """
    room = 4096 + 4 * n
    while True:
        try:
            samples, bits = _subframe(_Bits(data[at : at + room]), n, bps)
            return samples, at + -(-bits // 8)
        except EndOfBits:
            if at + room >= len(data):
                raise
            room *= 2


def _subframe(b: _Bits, n: int, bps: int) -> tuple[np.ndarray, int]:
    """Samples of the subframe, and the bits it takes."""
    if b.take(1):
        raise Damaged("subframe header")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
    bps -= wasted
    if kind == 0:
        out = [b.signed(bps)] * n
    elif kind == 1:
        out = [b.signed(bps) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift, coefficients = [b.signed(bps) for _ in range(order)], 0, _FIXED[kind - 8] if kind < 32 else []
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coefficients = [b.signed(precision) for _ in range(order)]
        method, parts = b.take(2), 1 << b.take(4)
        for part in range(parts):
            k = b.take(4 + method)
            raw = b.take(5) if k == (15 if method == 0 else 31) else None
            for _ in range(n // parts - (order if part == 0 else 0)):
                if raw is not None:
                    r = b.signed(raw)
                else:
                    u = b.unary() << k | (b.take(k) if k else 0)
                    r = u >> 1 ^ -(u & 1)
                out.append(r + (sum(c * s for c, s in zip(coefficients, reversed(out), strict=False)) >> shift))
    else:
        raise Damaged(f"subframe type {kind}")
    return np.array(out, np.int64) << wasted, b.at


def _headers(stream: bytes) -> tuple[int, bytes, int]:
    """Number of samples, their MD5, and where the frames start."""
    if stream[:4] != b"fLaC":
        raise Damaged("no stream marker")
    at, last, info = 4, False, b""
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        info = stream[at + 4 : at + 4 + size] if kind == 0 else info
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
        raise Damaged("not 8-bit mono")
    return packed & (1 << 36) - 1, info[18:34], at


def _frame_header(stream: bytes, at: int) -> tuple[int, int]:
    """Number of samples, and where the subframe starts; sync code and CRC-8 are verified."""
    if stream[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise Damaged("no sync code")
    code, lead = stream[at + 2] >> 4, stream[at + 4]
    if code == 0:
        raise Damaged("reserved block size")
    p = at + 5 + (7 - (lead ^ 0xFF).bit_length() if lead >= 0xC0 else 0)
    if code in (6, 7):
        n = int.from_bytes(stream[p : p + code - 5], "big") + 1
        p += code - 5
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(stream[at + 2] & 15, 0)
    if crc8(stream[at:p]) != stream[p]:
        raise Damaged("frame header checksum")
    return n, p + 1


def _walk(jobs: list[tuple[bytes, int, int, int]]) -> list[tuple[np.ndarray, int]]:
    """Values of the Rice codes in each job (bytes, first bit, k, number of codes), and the bit behind them."""
    size = max(len(j[0]) for j in jobs) + 8
    raw = np.frombuffer(b"".join(j[0].ljust(size, b"\0") for j in jobs), np.uint8).reshape(len(jobs), size)
    bits = np.unpackbits(raw, axis=1)
    width = bits.shape[1]
    # Where the next set bit is, from each bit on; the last column stands for none.
    ahead = np.where(bits, np.arange(width, dtype=np.int32), np.int32(width - 1))
    ahead = np.ascontiguousarray(np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]).ravel()
    bits = bits.ravel()
    base = np.arange(len(jobs), dtype=np.int64) * width
    k = np.array([j[2] for j in jobs], np.int64)
    count = np.array([j[3] for j in jobs])
    at = np.array([j[1] for j in jobs], np.int64)
    most = int(count.max(initial=0))
    start, stop = np.zeros((most, len(jobs)), np.int64), np.zeros((most, len(jobs)), np.int64)
    for i in range(most):
        start[i] = at
        s = ahead.take(base + at)
        stop[i] = s
        at = np.minimum(s + 1 + k, width - 1)
    out: list[tuple[np.ndarray, int]] = [(np.zeros(0, np.int64), j[1]) for j in jobs]
    for one in np.unique(k):
        rows = np.flatnonzero(k == one)
        s = stop[:, rows]
        place = (s + base[rows] + 1).ravel()
        v = np.zeros(place.size, np.int64)
        for j in range(one):
            v = v << 1 | bits.take(place + j, mode="clip")
        v = v.reshape(s.shape) | (s - start[:, rows]) << one
        v = v >> 1 ^ -(v & 1)
        for c, r in enumerate(rows):
            if n := int(count[r]):
                out[r] = (v[:n, c], int(s[n - 1, c] + 1 + one))
    return out


def _frame_starts(stream: bytes, first: int, samples: int) -> list[tuple[int, int, int]]:
    """(begin, samples, subframe) of the frames, by sync codes whose header has a fitting checksum and the next number.

    Residuals may imitate a header; ``decode`` therefore checks that frames adjoin.
    A frame has at most the samples that STREAMINFO allows, so an imitated one takes no more room than others.
    """
    out, at, number, most = [], first, 0, int.from_bytes(stream[10:12], "big")
    sync = stream[first : first + 2]
    while samples > 0 and at >= 0:
        coded = _coded_number(number)
        if stream[at + 4 : at + 4 + len(coded)] == coded:
            try:
                n, p = _frame_header(stream, at)
            except _NO_FRAME:
                n = 0
            if 0 < n <= min(samples, most):
                out.append((at, n, p))
                samples -= n
                number += 1
        at = stream.find(sync, at + 2)
    return out


def _linear_head(s: bytes, m: int, order: int) -> tuple[list[int], int, int, int]:
    """Coefficients, shift, Rice parameter and the first residual bit behind byte ``m`` of a linear subframe; parameter 15 if it is not of the plain form."""
    held = int.from_bytes(s[m : m + 64].ljust(64, b"\0"), "big")
    take = lambda at, k: held >> (512 - at - k) & ((1 << k) - 1)
    precision, shift = take(0, 4) + 1, take(4, 5)
    if precision == 16 or shift > 15 or take(9 + order * precision, 6) or 19 + order * precision > 512:
        return [], 0, 15, 0
    half = 1 << (precision - 1)
    coefficients = [(take(9 + i * precision, precision) ^ half) - half for i in range(order)]
    return coefficients, shift, take(15 + order * precision, 4), 19 + order * precision


def _restore_linear(rows: list[tuple[np.ndarray, np.ndarray, list[int], int]]) -> list[np.ndarray]:
    """Samples of rows (first samples, residuals, coefficients, shift) of equal order, stepping along all of them."""
    order = len(rows[0][0])
    most = max(len(r[1]) for r in rows)
    x = np.zeros((order + most, len(rows)), np.int64)
    for c, (first, residuals, _, _) in enumerate(rows):
        x[:order, c] = first
        x[order : order + len(residuals), c] = residuals
    q = np.array([r[2][::-1] for r in rows], np.int64).T.copy()
    shift = np.array([r[3] for r in rows], np.int64)
    for t in range(order, order + most):
        x[t] += np.einsum("om,om->m", q, x[t - order : t]) >> shift
    return [x[: order + len(r[1]), c] for c, r in enumerate(rows)]


def _decode_frames(frames: list[tuple[bytes, int, int, int]]) -> list[tuple[np.ndarray, int]]:
    """Samples of each frame (stream, begin, samples, subframe), and the byte behind it; checksums are verified."""
    jobs, fast, out = [], [], [None] * len(frames)
    for i, (s, _, n, p) in enumerate(frames):
        kind, coefficients, shift, first, k = s[p] >> 1, None, 0, 10, 15
        order = kind - 8 if kind < 32 else kind - 31
        m = p + 1 + order
        if kind >= 32:
            coefficients, shift, k, first = _linear_head(s, m, order)
        elif 0 <= order <= 4 and m + 1 < len(s) and not s[m] >> 2:
            k = (s[m] & 3) << 2 | s[m + 1] >> 6
        if not s[p] & 1 and k < 15 and n > order:
            room = first // 8 + n * (k + 4) // 8 + 16  # codes seldom pass this; a frame that does is read on its own
            jobs.append((s[m : m + room], first, k, n - order))
            fast.append((i, room, order, coefficients, shift))
        else:
            out[i] = _decode_one(s, p, n, 8)
    linear: dict[int, list] = {}
    for (i, room, order, coefficients, shift), (codes, bit) in zip(fast, _walk(jobs) if jobs else [], strict=True):
        s, _, n, p = frames[i]
        if bit >= 8 * min(room, len(s) - p - 1 - order):
            out[i] = _decode_one(s, p, n, 8)
            continue
        first, end = np.frombuffer(s, np.int8, order, p + 1), p + 1 + order - (-bit // 8)
        if coefficients is not None:
            linear.setdefault(order, []).append((i, end, (first, codes, coefficients, shift)))
            continue
        t = np.empty(n, np.int64)
        t[order:] = codes
        if order:
            t[:order] = first
            for j in range(1, order):
                t[j:order] = np.diff(t[j - 1 : order])
            for j in range(order - 1, -1, -1):
                t[j:] = np.cumsum(t[j:])
        out[i] = t, end
    for rows in linear.values():
        for (i, end, _), t in zip(rows, _restore_linear([r for *_, r in rows]), strict=True):
            out[i] = t, end
    sums = crc16([f[0][f[1] : end] for f, (_, end) in zip(frames, out, strict=True)])
    for f, (_, end), c in zip(frames, out, sums.tolist(), strict=True):
        if int.from_bytes(f[0][end : end + 2], "big") != c:
            raise Damaged("frame checksum")
    return [(t.astype(np.int8), end) for t, end in out]


def _decode_in_order(stream: bytes, first: int, samples: int) -> list[tuple[int, np.ndarray, int]]:
    """Begin, samples and end of the frames, each found behind the one before."""
    out, at = [], first
    while samples > 0:
        n, p = _frame_header(stream, at)
        got, end = _decode_frames([(stream, at, n, p)])[0]
        out.append((at, got, end))
        samples -= n
        at = end + 2
    return out


def _one_or_none(frame: tuple[bytes, int, int, int]) -> tuple[np.ndarray, int] | None:
    """The frame on its own, so that a damaged one takes no other stream off the fast way."""
    try:
        return _decode_frames([frame])[0]
    except _NO_FRAME:
        return None


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Samples of each stream, and its blocks as (sample offset, byte offset, samples). Raises ``Damaged``.

    The frames of all streams are decoded side by side, ``FRAMES`` at a time.
    """
    heads = [_headers(s) for s in streams]
    starts = [_frame_starts(s, h[2], h[0]) for s, h in zip(streams, heads, strict=True)]
    order = sorted(((i, f) for i, fs in enumerate(starts) for f in range(len(fs))), key=lambda x: -starts[x[0]][x[1]][1])
    got: list[list] = [[None] * len(fs) for fs in starts]
    for lo in range(0, len(order), FRAMES):
        group = order[lo : lo + FRAMES]
        frames = [(streams[i], *starts[i][f]) for i, f in group]
        try:
            done = _decode_frames(frames)
        except _NO_FRAME:
            done = [_one_or_none(f) for f in frames]
        for (i, f), x in zip(group, done, strict=True):
            got[i][f] = x and (starts[i][f][0], *x)
    out = []
    for s, (n, md5, first), fs in zip(streams, heads, got, strict=True):
        ends = [first, *(f[2] + 2 for f in fs if f)]
        if any(f is None for f in fs) or [f[0] for f in fs] != ends[:-1] or sum(len(f[1]) for f in fs) != n:
            fs = _decode_in_order(s, first, n)
        samples = np.concatenate([f[1] for f in fs]) if fs else np.zeros(0, np.int8)
        if len(samples) != n or hashlib.md5(samples.tobytes()).digest() != md5:
            raise Damaged("samples do not fit their digest")
        at = np.concatenate(([0], np.cumsum([len(f[1]) for f in fs]))).tolist()
        out.append((samples, [(at[j], f[0], len(f[1])) for j, f in enumerate(fs)]))
    return out


def seek(stream: bytes, sample: int) -> int:
    """Byte offset in the stream of a frame at or before ``sample``, from the seek table."""
    _, _, first = _headers(stream)
    at, best = 4, 0
    while True:
        last, kind, size = stream[at] & 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 3:
            for p in range(at + 4, at + 4 + size, 18):
                if int.from_bytes(stream[p : p + 8], "big") <= sample:
                    best = int.from_bytes(stream[p + 8 : p + 16], "big")
        if last:
            return first + best
        at += 4 + size


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and the bytes with zeros up to a positive multiple of ``PAD``; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text of each row of ``docs`` (doc_id, text) as a FLAC stream.

    Equal texts give equal streams, null ones that of an empty text; repeated
    rows and null doc_ids are kept; an empty table gives no stream; other
    columns, whatever their names, are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload_of(t) for t in batch.column(1).to_pylist()]
        media = encode([p for _, p in made])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


BLOCKS = "array<struct<sample_offset:bigint,byte_offset:bigint,n_samples:bigint,pcm:binary>>"


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, blocks: stored streams decoded to PCM, one block for each frame.

    A block has its place among the samples and that of its frame in the stream,
    so a reader can begin at any block. A damaged stream fails the job; repeated
    rows are kept; an empty table gives none.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        streams = batch.column(2).to_pylist()
        made = decode(streams)
        blocks = [x for samples, bs in made for x in ((s, o, n, samples[s : s + n].tobytes()) for s, o, n in bs)]
        fields = [pa.array([b[i] for b in blocks], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        each = pa.StructArray.from_arrays(fields, names=["sample_offset", "byte_offset", "n_samples", "pcm"])
        ends = np.concatenate(([0], np.cumsum([len(bs) for _, bs in made]))).astype(np.int32)
        new = [pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.ListArray.from_arrays(pa.array(ends), each)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, blocks {BLOCKS}")


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, zero crossings of the centred signal and peak of the samples."""
    x = samples.astype(np.float64)
    up = x >= x.mean()
    return f"mean={x.mean():.3f};std={x.std():.3f};crossings={int(np.count_nonzero(up[1:] != up[:-1]))};peak={int(np.abs(samples.astype(np.int16)).max(initial=0))}"


RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_byte_offset long"


def measure(decoded: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``RESULT`` of ``pcm_blocks``, the payload put together again by sample offsets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for size, digest, blocks in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            blocks.sort(key=lambda b: b["sample_offset"])
            samples = np.frombuffer(b"".join(b["pcm"] for b in blocks), np.int8)
            payload = payload_from(samples)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), size, digest, feature(samples), len(blocks), blocks[-1]["byte_offset"]))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["doc_id", "n_bytes", *(x.split()[0] for x in RESULT.split(", "))])

    kind = decoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(decoded, run, f"doc_id {kind}, n_bytes long, {RESULT}")


def op8_flac_media(spark, sf_dir: str) -> DataFrame:
    stored = written(to_media(table(spark, sf_dir, "documents")))
    return measure(pcm_blocks(stored))
