"""Decoding FLAC recordings: Rice-coded residuals, fixed and linear predictors, decorrelated channels.

Bits of a frame are unpacked at once; Python goes from one stop bit to the next, numpy reads the values between.  Fixed predictors are
running sums; linear ones are undone for all subframes of a recording in step, sample by sample.  The stream's checksum of all samples, where the encoder wrote one,
and its count are verified, so that a damaged or cut-off recording is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SIDE = {8: (0, 1), 9: (1, 0), 10: (0, 1)}  # extra bit of each channel: left and side, side and right, middle and side
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class _End(ValueError):
    """The bits at hand end within a frame."""


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        at = np.where(self.bits == 1, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(at[::-1])[::-1].tolist()
        self.at = 0

    def _take(self, n: int) -> int:
        start, self.at = self.at, self.at + n
        if self.at > len(self.bits):
            raise _End("the recording ends within a frame")
        return start

    def read(self, n: int) -> int:
        start = self._take(n)
        return int.from_bytes(np.packbits(np.pad(self.bits[start : self.at], (-n % 8, 0))).tobytes(), "big")

    def signed(self, n: int) -> int:
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        if self.at >= len(self.bits) or (one := self.next_one[self.at]) >= len(self.bits):
            raise _End("the recording ends within a frame")
        zeros, self.at = one - self.at, one + 1
        return zeros

    def many(self, count: int, n: int) -> np.ndarray:
        """``count`` signed numbers of ``n`` bits."""
        start = self._take(count * n)
        return _signed(self.values(start + n * np.arange(count), n), n)

    def values(self, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(starts), np.int64)
        for k in range(n):
            out = (out << 1) | self.bits[starts + k]
        return out

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` numbers in Rice code of parameter ``k``."""
        ones, at, ends, limit = self.next_one, self.at, [], len(self.bits)
        for _ in range(count):
            if at >= limit or (one := ones[at]) + k >= limit:
                raise _End("the recording ends within a frame")
            ends.append(one)
            at = one + 1 + k
        stop = np.array(ends, np.int64)
        first = np.concatenate([[self.at], stop[:-1] + 1 + k]) if count else stop
        self.at = at
        u = ((stop - first) << k) | self.values(stop + 1, k)
        return (u >> 1) ^ -(u & 1)


def _signed(x: np.ndarray, n: int) -> np.ndarray:
    return np.where(x >> (n - 1) & 1, x - (1 << n), x) if n else x


def _residual(b: _Bits, n: int, order: int) -> np.ndarray:
    method = b.read(2)
    if method > 1:
        raise ValueError("unknown coding of residuals")
    width, parts = 4 + method, 1 << b.read(4)
    if n % parts or n // parts < order:
        raise ValueError("partitions don't fit the block")
    out = []
    for p in range(parts):
        many, k = n // parts - (order if p == 0 else 0), b.read(width)
        out.append(b.rice(many, k) if k < (1 << width) - 1 else b.many(many, b.read(5)))
    return np.concatenate(out)


def _subframe(b: _Bits, n: int, bits: int, waiting: list) -> np.ndarray:
    """The samples of a subframe; those of a linear predictor are filled in later, from what is added to ``waiting``."""
    if b.read(1):
        raise ValueError("a subframe begins with a set bit")
    kind, wasted = b.read(6), 0
    if b.read(1):
        wasted = b.unary() + 1
        bits -= wasted
    out = np.zeros(n, np.int64)
    if kind == 0:
        out[:] = b.signed(bits)
    elif kind == 1:
        out[:] = b.many(n, bits)
    elif 8 <= kind <= 12:
        order = kind - 8
        start, rest = b.many(order, bits), _residual(b, n, order)
        out[:] = np.concatenate([start, rest])
        for k in range(order, 0, -1):  # the k-th differences begin with those of the first k samples
            head = np.diff(start, k - 1)[:1]
            out[k - 1 :] = np.cumsum(np.concatenate([head, out[k:]]))
        out[:order] = start
    elif kind >= 32:
        order = kind - 31
        start = b.many(order, bits)
        precision = b.read(4) + 1
        if precision == 16:
            raise ValueError("unknown precision of a predictor")
        shift, taps = b.signed(5), b.many(order, precision)
        if shift < 0:
            raise ValueError("a predictor is shifted to the left")
        out[:] = np.concatenate([start, _residual(b, n, order)])
        waiting.append((out, order, shift, taps, wasted))
        return out
    else:
        raise ValueError("unknown kind of subframe")
    out <<= wasted
    return out


def _predict(waiting: list) -> None:
    """Undo linear predictors in place: subframes of one length go in step."""
    for n in {len(x[0]) for x in waiting}:
        of = [x for x in waiting if len(x[0]) == n]
        most = max(x[1] for x in of)
        taps = np.zeros((len(of), most), np.int64)
        for row, (_, order, _, t, _) in zip(taps, of, strict=True):
            row[most - order :] = t[::-1]
        order, shift = (np.array([x[k] for x in of]) for k in (1, 2))
        s = np.zeros((len(of), most + n), np.int64)
        s[:, most:] = [x[0] for x in of]
        for i in range(n):
            guess = (s[:, i : i + most] * taps).sum(axis=1) >> shift
            s[:, most + i] += np.where(order <= i, guess, 0)
        for (out, *_, wasted), row in zip(of, s, strict=True):
            out[:] = row[most:] << wasted


def _number(b: _Bits) -> None:
    """Pass over the frame's number, which is written like a character."""
    first = b.read(8)
    while first & 0x40 and first & 0x80:
        b.read(8)
        first = (first << 1 | 0x80) & 0xFF
    return


def _frame(b: _Bits, bits: int) -> tuple[int, list[np.ndarray], list, int]:
    """Channels' code, samples of each channel, what waits for prediction, and the bits of a sample."""
    if b.read(14) != 0x3FFE:
        raise ValueError("a frame doesn't begin with its mark")
    b.read(2)
    size, rate, channels, width = b.read(4), b.read(4), b.read(4), b.read(3)
    b.read(1)
    _number(b)
    if size == 0 or channels > 10 or width == 3:
        raise ValueError("a frame's head holds a reserved value")
    n = 192 if size == 1 else 576 << (size - 2) if size < 6 else b.read(8) + 1 if size == 6 else b.read(16) + 1 if size == 7 else 256 << (size - 8)
    b.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
    b.read(8)
    bits = _BITS.get(width, bits)
    waiting: list = []
    out = [_subframe(b, n, bits + extra, waiting) for extra in _SIDE.get(channels, (0,) * (channels + 1))]
    b.read(-b.at % 8 + 16)
    return channels, out, waiting, bits


def decode_flac(data: bytes) -> tuple[np.ndarray, int, int]:
    """Interleaved samples between -1 and 1, rate and channels."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise ValueError("the recording ends within its head")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x80:
            break
    if info is None or len(info) < 34:
        raise ValueError("the stream has no head")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, bits, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    largest = int.from_bytes(info[2:4], "big")
    frames, waiting, count = [], [], 0
    while at < len(data) and (not total or count < total):
        room = (largest * channels * (bits + 2)) // 8 + 1024
        while True:  # a frame's length isn't known before it has been read
            b = _Bits(data[at : at + room])
            try:
                code, parts, wait, bits = _frame(b, bits)
                break
            except _End:
                if at + room >= len(data):
                    raise
                room *= 4
        if len(parts) != channels:
            raise ValueError("a frame has another number of channels")
        frames.append((code, parts))
        waiting += wait
        count += len(parts[0])
        at += b.at // 8
    if total and count < total or not count:
        raise ValueError(f"{count} of {total} samples are there")
    _predict(waiting)
    out = []
    for code, (first, *rest) in frames:
        if code == 8:
            rest = [first - rest[0]]
        elif code == 9:
            first = first + rest[0]
        elif code == 10:
            side = rest[0]
            middle = first * 2 + (side & 1)
            first, rest = (middle + side) >> 1, [(middle - side) >> 1]
        out.append(np.stack([first, *rest], axis=1))
    x = np.concatenate(out)[: total or None]
    width = (bits + 7) // 8
    raw = x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    if any(info[18:34]) and hashlib.md5(raw, usedforsecurity=False).digest() != info[18:34]:
        raise ValueError("the samples differ from their checksum")
    return (x.ravel() / float(1 << (bits - 1))).astype(np.float32), rate, channels
