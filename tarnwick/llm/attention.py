"""A small causal self-attention model in numpy: one block, relative positions, groups and classes of ids as output.

The probability of an id is that of its group, times that of its class in the group, both from the
model, times the id's share of its class, from smoothed corpus counts.  Ids that mostly begin a word, end one,
or stand inside have groups of their own; within these they are put into classes of about equal mass by descending count.
Weights are views of one flat array, so that they are averaged and stepped as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np

WIDTH, HIDDEN, GROUPS, EACH = 16, 32, 16, 16
CLASSES = GROUPS * EACH
WINDOW, STRIDE = 32, 16
OWN_ROWS, SHARED_ROWS = 4096, 1024
_MOST = 60.0  # logits beyond it are cut, so that no exponential overflows
TILE, _PIECES = 32, 4
_GROUPS = np.arange(GROUPS)
_LEVEL = np.repeat(np.eye(2), [GROUPS, EACH], axis=0)  # of each logit
SHAPES = {
    "e": (OWN_ROWS + SHARED_ROWS, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "o": (WIDTH, WIDTH), "near": (WINDOW,), "a": (WIDTH, HIDDEN), "a0": (HIDDEN,), "b": (HIDDEN, WIDTH),
    "u": (WIDTH, GROUPS), "u0": (GROUPS,), "v": (GROUPS, WIDTH, EACH), "v0": (GROUPS, EACH),
}
_SIZES = {name: int(np.prod(s)) for name, s in SHAPES.items()}
SIZE, _TABLE = sum(_SIZES.values()), _SIZES["e"]  # the embedding comes first


def views(flat: np.ndarray, skip: int = 0) -> dict[str, np.ndarray]:
    """The weights, without the first ``skip``, that lie in a flat array."""
    out, at = {}, 0
    for name in list(SHAPES)[skip:]:
        out[name] = flat[at : at + _SIZES[name]].reshape(SHAPES[name])
        at += _SIZES[name]
    return out


@dataclass
class Vocabulary:
    """What corpus counts fix: each id's row of the embedding, its class, and the log share in its class."""

    row: np.ndarray
    klass: np.ndarray
    log_share: np.ndarray
    share: np.ndarray  # of each class

    @staticmethod
    def of(counts: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> Vocabulary:
        """``first`` and ``last``: how many of an id's occurrences begin or end a word."""
        n = len(counts)
        smooth = counts.astype(float) + 1
        order = np.lexsort((np.arange(n), -counts))
        kind = np.zeros(n, int) if first is None or last is None else 2 * (2 * first > counts) + (2 * last > counts)
        mass = np.bincount(kind, weights=smooth, minlength=4)
        groups = np.maximum((mass / mass.sum() * GROUPS).astype(int), mass > 0)
        groups[mass.argmax()] += GROUPS - groups.sum()
        klass, at = np.zeros(n, np.int32), 0
        for k in range(4):
            ids = order[kind[order] == k]
            klass[ids] = at * EACH + _equal_classes(smooth[ids], int(groups[k]) * EACH)
            at += int(groups[k])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        row = np.where(rank < OWN_ROWS, rank, OWN_ROWS + np.arange(n) % SHARED_ROWS)
        total = np.bincount(klass, weights=smooth, minlength=CLASSES)
        return Vocabulary(row.astype(np.int32), klass, np.log(smooth / total[klass]).astype(np.float32), np.maximum(total, 0.5) / total.sum())


def _equal_classes(mass: np.ndarray, classes: int) -> np.ndarray:
    """The class of each item of descending ``mass``: a class is closed when it holds its share of what is left."""
    out, k, held, left = np.zeros(len(mass), np.int32), 0, 0.0, float(mass.sum())
    for i, m in enumerate(mass.tolist()):
        out[i] = k
        held += m
        if held >= left / (classes - k) and k < classes - 1:
            left -= held
            k, held = k + 1, 0.0
    return out


def fresh(vocabulary: Vocabulary | None = None, seed: int = 7) -> np.ndarray:
    """Starting weights; the output starts at the classes' shares of the corpus."""
    r = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    w = views(flat)
    for name, by in (("e", 0.3), ("qkv", WIDTH**-0.5), ("o", WIDTH**-0.5), ("a", WIDTH**-0.5), ("b", HIDDEN**-0.5), ("u", 0.1), ("v", 0.1)):
        w[name][:] = r.standard_normal(w[name].shape) * by
    if vocabulary is not None:
        share = vocabulary.share.reshape(GROUPS, EACH)
        w["u0"][:] = np.log(share.sum(axis=1))
        w["v0"][:] = np.log(share / share.sum(axis=1, keepdims=True))
    return flat


def _cut(z: np.ndarray) -> np.ndarray:
    """Exponentials of logits, in their place."""
    if z.size and z.max() > _MOST:
        np.minimum(z, _MOST, out=z)
    return np.exp(z, out=z)


@lru_cache
def _gaps(t: int) -> np.ndarray:
    """How far each place of a window of ``t`` lies behind each; ``t`` for those that come later."""
    gap = np.arange(t)[:, None] - np.arange(t)
    return np.where(gap < 0, t, gap)


def _by(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, in runs of rows: small products take a shorter way through BLAS."""
    runs = _PIECES if len(x) % _PIECES == 0 else 1
    return (x.reshape(runs, -1, x.shape[1]) @ np.ascontiguousarray(w)).reshape(len(x), -1)


def _across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y``, summed over runs of rows."""
    runs = _PIECES if len(x) % _PIECES == 0 else 1
    return (x.reshape(runs, -1, x.shape[1]).transpose(0, 2, 1) @ y.reshape(runs, -1, y.shape[1])).sum(axis=0)


def _folded(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The products of weights that attention needs: of queries and keys, scaled, and of values and output."""
    d = WIDTH
    qk = w["qkv"][:, :d] @ w["qkv"][:, d : 2 * d].T
    qk *= qk.dtype.type(d**-0.5)
    return qk, w["qkv"][:, 2 * d :] @ w["o"]


def _levels(w: dict[str, np.ndarray]) -> np.ndarray:
    """For each group, weights of the logits of all groups and then of its own classes; constants come last."""
    out = np.empty((GROUPS, WIDTH + 1, GROUPS + EACH), w["u"].dtype)
    out[:, :WIDTH, :GROUPS], out[:, :WIDTH, GROUPS:], out[:, WIDTH, :GROUPS], out[:, WIDTH, GROUPS:] = w["u"], w["v"], w["u0"], w["v0"]
    return out


class _Tiles:
    """Places put together by the group of their class, in tiles of ``TILE`` that each have one group.

    ``group`` is of each tile, ``places`` of each row of the tiles (``n`` in the rows that fill a tile up, ``filled``), ``at``
    the row of each real place, in the order of ``real``; ``right`` where the logits of its group and class lie.
    """

    def __init__(self, klass: np.ndarray, real: np.ndarray | None):
        n, group = len(klass), klass // EACH
        own = klass - EACH * group
        kind = group.astype(np.uint8)
        if real is not None:
            kind[~real] = GROUPS
        counts = np.bincount(kind, minlength=GROUPS)[:GROUPS].tolist()
        tiles = [-(-c // TILE) for c in counts]
        many, rows = sum(counts), TILE * sum(tiles)
        self.real = kind.argsort(kind="stable")[:many]
        self.group = np.repeat(_GROUPS, tiles)
        behind = [0, *accumulate(TILE * a - b for a, b in zip(tiles, counts, strict=True))][:GROUPS]
        self.at = np.arange(many)
        self.at += np.repeat(behind, counts)
        self.places = np.full(rows, n)
        self.places[self.at] = self.real
        self.filled = np.flatnonzero(self.places == n)
        first = self.at * (GROUPS + EACH)
        self.right = np.empty(2 * many, np.int64)
        np.add(first, group.take(self.real), out=self.right[:many])
        np.add(first, own.take(self.real), out=self.right[many:])
        self.right[many:] += GROUPS

    def exponentials(self, levels: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows of ``y`` [n + 1, WIDTH + 1] in tiles, exponentials of their logits, the sums of these by level, and the logits of ``right``."""
        ys = y.take(self.places, axis=0)
        e = (ys.reshape(-1, TILE, WIDTH + 1) @ levels.take(self.group, axis=0)).reshape(-1, GROUPS + EACH)
        right = e.ravel().take(self.right)
        _cut(e)
        return ys, e, e @ _LEVEL.astype(e.dtype), right


def _with_one(y: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The sum, with ones in a last column, and a last row of zeros."""
    out = np.empty((len(y) + 1, WIDTH + 1), y.dtype)
    np.add(y, more, out=out[:-1, :WIDTH])
    out[:-1, WIDTH], out[-1] = 1, 0
    return out


def _output(w: dict[str, np.ndarray], y: np.ndarray, klass: np.ndarray, real: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of classes after the rows of ``y`` [n + 1, WIDTH + 1], and its gradients: of these rows, and of what :func:`_levels` gives."""
    kind, tiles, levels = y.dtype, _Tiles(klass, real), _levels(w)
    ys, e, s, right = tiles.exponentials(levels, y)
    many = len(tiles.at)
    loss = float((np.log(s).take(tiles.at, axis=0).sum() - right.sum()) / many)
    share = kind.type(1 / many)
    s = share / s
    s[tiles.filled] = 0
    e *= s @ _LEVEL.T.astype(kind)
    e.reshape(-1)[tiles.right] -= share
    e = e.reshape(-1, TILE, GROUPS + EACH)
    of_tile = ys.reshape(-1, TILE, WIDTH + 1).transpose(0, 2, 1) @ e
    g_levels = ((tiles.group == _GROUPS[:, None]).astype(kind) @ of_tile.reshape(len(of_tile), -1)).reshape(levels.shape)
    dys = (e @ np.ascontiguousarray(levels[:, :WIDTH].transpose(0, 2, 1)).take(tiles.group, axis=0)).reshape(-1, WIDTH)
    of = np.zeros(len(klass), np.int64)
    of[tiles.real] = tiles.at
    dy = dys.take(of, axis=0)
    if many < len(klass):
        dy[~real] = 0
    return loss, dy, g_levels


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, klass: np.ndarray, real: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss of classes ``klass`` [B, T] after embedding rows ``rows`` [B, T], and its gradients.

    They are those of all weights but the embedding, flat, and the embedding rows that occur with theirs.
    Where ``real`` is false, after a window's end, a place counts neither for the loss nor for the gradients.
    Only products of queries and keys, and of values and output, take part, so their weights are multiplied first: with
    as many features in each as in the embedding, that is fewer products over the batch, and the same function.
    """
    n, t = rows.shape
    d, kind, rows = WIDTH, w["e"].dtype, rows.ravel()
    ones, gap = np.ones(n * t, kind), _gaps(t)
    x = w["e"].take(rows, axis=0)
    x3 = x.reshape(n, t, d)
    qk, vo = _folded(w)
    q, v = (x @ qk).reshape(n, t, d), (x @ vo).reshape(n, t, d)
    p = _cut(q @ np.ascontiguousarray(x3.transpose(0, 2, 1)))
    p *= np.append(np.exp(w["near"][:t]), kind.type(0)).take(gap)
    p /= (p.reshape(-1, t) @ ones[:t]).reshape(n, t, 1)
    c = (p @ v).reshape(-1, d)
    h = x + c
    f = _by(h, w["a"])
    f += w["a0"]
    on = (f > 0).astype(kind)
    f *= on
    y = _with_one(_by(f, w["b"]), h)

    loss, dy, g_levels = _output(w, y, klass.ravel(), None if real is None else real.ravel())
    del y
    df = _by(dy, w["b"].T)
    df *= on
    dh = _by(df, w["a"].T)
    dh += dy
    c *= dh
    less = np.empty((n, t, d + 1), kind)  # a place's gradient, and the part that its own shares take from it
    less[..., :d], less[..., d] = dh.reshape(n, t, d), (c @ np.ones(d, kind)).reshape(n, t)
    against = np.empty((n, d + 1, t), kind)
    against[:, :d], against[:, d] = v.transpose(0, 2, 1), -1
    ds = less @ against
    ds *= p
    dv = (p.transpose(0, 2, 1) @ dh.reshape(n, t, d)).reshape(-1, d)
    dq = (ds @ x3).reshape(-1, d)
    dx = (ds.transpose(0, 2, 1) @ q).reshape(-1, d)
    dx += dh
    dx += _by(dq, qk.T)
    dx += _by(dv, vo.T)
    g_qk, g_vo = x.T @ dq, x.T @ dv
    g_near = np.zeros(WINDOW, kind)
    g_near[:t] = np.bincount(gap.ravel(), weights=ones[:n] @ ds.reshape(n, t * t), minlength=t)[:t]
    g_qk *= kind.type(d**-0.5)
    of_q, of_k, of_v = w["qkv"][:, :d], w["qkv"][:, d : 2 * d], w["qkv"][:, 2 * d :]
    g_qkv = np.concatenate([g_qk @ of_k, g_qk.T @ of_q, g_vo @ w["o"].T], axis=1)
    g_all, g_own = g_levels[..., :GROUPS].sum(axis=0), g_levels[..., GROUPS:]
    dense = [g_qkv, of_v.T @ g_vo, g_near, _across(h, df), ones @ df, _across(dy, f).T, g_all[:d], g_all[d], g_own[:, :d], g_own[:, d]]

    order = np.argsort(rows.astype(np.uint16), kind="stable")
    seen = rows.take(order)
    new = np.ones(n * t, bool)
    np.not_equal(seen[1:], seen[:-1], out=new[1:])
    new = np.flatnonzero(new)
    return loss, np.concatenate([g.ravel() for g in dense]), seen.take(new), np.add.reduceat(dx.take(order, axis=0), new, axis=0)


def keep_memory() -> None:
    """Let the process keep what a step frees: glibc maps a step's arrays anew each time, page by page, until a larger one has been freed."""
    np.empty(1 << 24, np.uint8)


class Adam:
    """Adaptive moments, with state kept between calls; those of an embedding row move when it occurs."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.w, self.rate, self.t = flat, views(flat), rate, 0
        self.m, self.s = np.zeros_like(flat[_TABLE:]), np.zeros_like(flat[_TABLE:])
        self.moments = np.zeros((OWN_ROWS + SHARED_ROWS, 2 * WIDTH), flat.dtype)  # those of an embedding row

    def learn(self, rows: np.ndarray, klass: np.ndarray, real: np.ndarray | None = None) -> float:
        """One step on a batch; its loss before the step."""
        loss, dense, seen, table = gradients(self.w, rows, klass, real)
        self.t += 1
        rate = np.float32(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        self.flat[_TABLE:] -= self._step(rate, dense, self.m, self.s)
        both = self.moments.take(seen, axis=0)
        table = self._step(rate, table, both[:, :WIDTH], both[:, WIDTH:])
        self.moments[seen] = both
        self.w["e"][seen] -= table
        return loss

    @staticmethod
    def _step(rate: np.float32, g: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
        """What to take off the weights; moments are moved in place."""
        m += np.float32(0.1) * (g - m)
        s += np.float32(0.01) * (g * g - s)
        out = np.sqrt(s)
        out += np.float32(1e-8)
        return np.divide(rate * m, out, out=out)


def score_stream(w: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray, start_id: int, at_once: int = 512) -> np.ndarray:
    """Sum of natural-log probabilities of the ids of each text (``off``: where each begins, and the end).

    Windows of ``WINDOW`` ids overlap by ``WINDOW - STRIDE``; a window scores its last ``STRIDE`` ids, so every
    id is scored once, after ``WINDOW - STRIDE`` ids at least where its text has them.
    """
    n = np.diff(off)
    blocks = -(-n // STRIDE)
    first = np.concatenate([[0], np.cumsum(blocks)])
    n_blocks, lead = int(first[-1]), WINDOW - STRIDE
    # each text's input, shifted by one, in rows of STRIDE; its windows look back over the rows before
    place = np.arange(len(ids)) + np.repeat(first[:-1] * STRIDE - off[:-1], n)
    before = np.empty(len(ids), ids.dtype)
    before[1:] = ids[:-1]
    before[off[:-1][n > 0]] = start_id
    rows = np.zeros(lead + n_blocks * STRIDE, np.int32)
    rows[lead + place] = vocabulary.row[before]
    klass = np.zeros(n_blocks * STRIDE, np.int32)
    klass[place] = vocabulary.klass[ids]
    real = np.zeros(n_blocks * STRIDE, bool)
    real[place] = True
    head = np.zeros(n_blocks, bool)
    head[first[:-1][blocks > 0]] = True
    gap = (lead + np.arange(STRIDE))[:, None] - np.arange(WINDOW)
    near = np.where(gap >= 0, np.exp(w["near"][np.clip(gap, 0, WINDOW - 1)]), 0).astype(np.float32)
    out = np.zeros(n_blocks * STRIDE, np.float32)
    qk, vo = _folded(w)
    levels, ones = _levels(w), np.ones(WINDOW, np.float32)
    for a in range(0, n_blocks, at_once):
        b = min(n_blocks, a + at_once)
        x = w["e"].take(rows[a * STRIDE : b * STRIDE + lead], axis=0)
        v = x @ vo
        step, item = x.strides
        x3, v3 = (np.lib.stride_tricks.as_strided(z, (b - a, WINDOW, WIDTH), (STRIDE * step, step, item)) for z in (x, v))  # a window's rows, in place
        h = x[lead:]
        p = _cut((h @ qk).reshape(b - a, STRIDE, WIDTH) @ np.ascontiguousarray(x3.transpose(0, 2, 1)))
        p *= near
        p[head[a:b], :, :lead] = 0
        c = p @ v3
        c /= (p.reshape(-1, WINDOW) @ ones).reshape(b - a, STRIDE, 1)
        h += c.reshape(-1, WIDTH)
        f = _by(h, w["a"])
        f += w["a0"]
        f *= (f > 0).astype(np.float32)
        y = _with_one(_by(f, w["b"]), h)
        part = slice(a * STRIDE, b * STRIDE)
        tiles = _Tiles(klass[part], real[part])
        _, _, s, right = tiles.exponentials(levels, y)
        s = np.log(s[:, 0] * s[:, 1]).take(tiles.at)
        out[part][tiles.real] = right[: len(s)] + right[len(s) :] - s
    each = out[place].astype(np.float64) + vocabulary.log_share[ids]
    total = np.zeros(len(ids) + 1)
    np.cumsum(each, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
