"""Words and hashes of many texts at once, straight from an Arrow text buffer.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All functions work on the
concatenated UTF-8 bytes of a block of texts, so a block costs a fixed number of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Masks of the lowest 0 to 8 bytes of a 64-bit number.
_LOWEST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SIZE, _PLACE, _SECOND = np.uint64(0x9E6D62D06F6A9A9B), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, max_bytes: int = 1 << 21, max_rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split a string or binary column into (first row, bytes, offsets) of about ``max_bytes`` and at most ``max_rows`` rows.

    Nulls count as empty.  A text longer than the limit makes a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
        to = min(n, at + max_rows, max(at + 1, to))
        yield at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of its first word (one more at the end)."""
    n = len(raw)
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def eights(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans as 64-bit numbers, eight to one and the last filled up with zeros; where each span's begin (one more at the end).

    With its length, a span's numbers are its bytes: two spans are equal if both agree.
    """
    many = (end - start + 7) >> 3
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(start - 8 * first[:-1], many) + 8 * np.arange(first[-1])
    whole = np.zeros(len(raw) // 8 + 2, "<u8")
    whole.view(np.uint8)[: len(raw)] = raw
    slot, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    value = whole[slot] >> shift
    value |= (whole[slot + 1] << np.uint64(1)) << (np.uint64(63) - shift)
    value &= _LOWEST[np.minimum(np.repeat(end, many) - at, 8)]
    return value, first


def _runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Spans that follow each other in runs of about ``at_once`` bytes: numbers of the spans, their bytes, starts and ends."""
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + at_once)))
        lo, hi = int(start[a]), int(end[b - 1])
        yield a, b, raw[lo:hi], start[a:b] - lo, end[a:b] - lo
        a = b


def _hash(value: np.ndarray, first: np.ndarray, size: np.ndarray, second: bool = False) -> np.ndarray:
    many = np.diff(first)
    place = np.zeros(len(value), np.uint64)
    far = ragged(first[:-1][many > 1], many[many > 1])
    place[far] = (far - np.repeat(first[:-1][many > 1], many[many > 1])).astype(np.uint64) * _PLACE
    value = mix(value + mix(place))
    if second:
        value = mix(value * _SECOND + _PLACE)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * _SIZE)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 1 << 22, second: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: equal bytes hash alike wherever they stand.

    Every eight bytes are mixed with their place in the span on their own, then summed and mixed with the length: no bytes that
    only change places, and no pattern of repeats, cancel out.  ``second``: of another function, which shares no collisions with the first.
    Spans follow each other; a long text is hashed in runs of about ``at_once`` bytes.
    """
    out = np.empty(len(start), np.uint64)
    for a, b, part, lo, hi in _runs(raw, start, end, at_once):
        out[a:b] = _hash(*eights(part, lo, hi), hi - lo, second)
    return out


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What :func:`hashes` gives, of spans in any order."""
    return _hash(*eights(raw, start, end), end - start)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text, given :func:`words`' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each text; 0 for a text without values."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def binary(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array of the runs of ``values`` between ``off``."""
    ends = (off * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary array in a row, and where each of its items begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.dtype(kind).itemsize
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (off - off[0]) // size


def ragged(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places of ``many`` neighbours from each of ``first`` on."""
    ends = np.cumsum(many)
    return np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


def different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For hashes: an occurrence of each different one, the number of each, and how often each occurs."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.empty(len(s), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    at = np.flatnonzero(new)
    return order[at], number, np.diff(np.append(at, len(s)))


def _equal(value: np.ndarray, first: np.ndarray, theirs: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether spans of one length have equal numbers: those from ``first`` on (one more at the end) and those of ``theirs`` from ``other`` on."""
    many = np.diff(first)
    out = many == 0
    one = np.flatnonzero(many == 1)
    out[one] = value[first[one]] == theirs[other[one]]
    long = np.flatnonzero(many > 1)
    wrong = np.concatenate([[0], np.cumsum(value[ragged(first[long], many[long])] != theirs[ragged(other[long], many[long])])])
    ends = np.cumsum(many[long])
    out[long] = wrong[ends] == wrong[ends - many[long]]
    return out


def agree(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, o_start: np.ndarray, o_end: np.ndarray) -> np.ndarray:
    """Whether each span of ``raw`` has the bytes of the span of ``other`` in its place."""
    out = end - start == o_end - o_start
    on = np.flatnonzero(out)
    value, first = eights(raw, start[on], end[on])
    theirs, at = eights(other, o_start[on], o_end[on])
    out[on] = _equal(value, first, theirs, at[:-1])
    return out


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray | None = None, h: np.ndarray | None = None, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`different` gives, for the bytes of spans (and their ``kind``) rather than for their hashes ``h``.

    Hashes only sort: every span is compared with the one that stands for it, and what differs gets a number of its own.
    Spans follow each other.
    """
    packed = eights(raw, start, end) if len(raw) <= at_once else None
    if h is None:
        h = hashes(raw, start, end, at_once) if packed is None else _hash(*packed, end - start)
    one, number, times = different(h if kind is None else h ^ kind.astype(np.uint64))
    rep = one[number]
    same = end - start == (end - start)[rep]
    if kind is not None:
        same &= kind == kind[rep]
    if packed is not None and same.all():
        same = _equal(*packed, packed[0], packed[1][rep])
    else:
        theirs, first = eights(raw, start[one], end[one])
        for a, b, part, lo, hi in _runs(raw, start, end, at_once):
            on = np.flatnonzero(same[a:b])
            same[a + on] = _equal(*eights(part, lo[on], hi[on]), theirs, first[number[a:b][on]])
    lost = np.flatnonzero(~same)
    if not len(lost):
        return one, number, times
    own: dict[tuple, int] = {}
    ones, counts = list(one), times.tolist()
    for i in lost.tolist():
        key = (raw[start[i] : end[i]].tobytes(), None if kind is None else int(kind[i]))
        counts[number[i]] -= 1
        if key not in own:
            own[key] = len(ones)
            ones.append(i)
            counts.append(0)
        number[i] = own[key]
        counts[own[key]] += 1
    return np.array(ones), number, np.array(counts)


class Numbered:
    """Numbers of 64-bit hashes, in an open table that grows."""

    def __init__(self):
        self.n, self.bits = 0, 14
        self._clear()

    def _clear(self) -> None:
        self.key, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        slot = self._slot(keys)
        out = self.number[slot]
        on = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[on] = self.number[slot]
            more = (out[on] >= 0) & (self.key[slot] != keys[on])
            on, slot = on[more], slot[more]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Number different keys that have no number yet."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old = self.number >= 0
            keys, numbers = np.concatenate([self.key[old], keys]), np.concatenate([self.number[old], numbers])
            self.n, self.bits = 0, int(4 * len(keys)).bit_length()
            self._clear()
        self.n += len(keys)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.number[slot] < 0
            self.number[slot[free]], self.key[slot[free]] = numbers[left[free]], keys[left[free]]
            lost = self.key[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)
