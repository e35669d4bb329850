"""Hard negatives by dual-tree search over anchors and candidates.

An anchor's positives are the rows of its label with the largest inner products; for each of them the negatives are the best rows of
other labels whose product lies in a window below the positive's.

1.  Planes fitted on a bounded sample cut the space into the leaves of a binary tree; every row is routed, none is left out.  A leaf's rows
    make blocks of bounded size, each with its centre and radius; nodes above cover their children's balls.  Candidates and
    anchors have a tree each.  Inside a block the cutting goes on down to ``NODE_ROWS`` rows.
2.  Products of an anchor node and a candidate node lie within <a, c> -/+ (R |a| + r |c| + r R) for centres a, c and radii r, R.  The search goes
    down both trees from the pair of roots, a level at a time: a pair of nodes stays while its interval meets the range of scores that
    some anchor below still needs, so that whole groups of anchors are dropped at once.  The last level's pairs of blocks do the same
    with their inner nodes, and score what is left exactly.
3.  What an anchor needs starts from the sample: the k best scores there are a floor for those of the whole table.

The search runs once for positives and once for negatives.  Components x are floor(``SCALE`` * x).  Products that floating point can't hold exactly
are computed in whole numbers of any size; a score beyond 64 bits is given as the nearest 64-bit number, all comparisons are exact.

Cases: rows with a null id or label, a null or empty vector, or one with a null or non-finite component take no part.  Vectors of different
lengths are compared over their common components.  Rows that repeat an id are candidates each, anchors each too, and never meet their own id.
Without positives, or with negative ones alone, an anchor has no rows; a positive of score 0 takes negatives of score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import arrow_rows, materialise
from .topk import _LEAST, _MOST, _WIDE, EXACT, _matrix, _starts

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows and bytes of the sample that fits the planes and gives the first floors; it is sent with every task.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 1 << 24
#: Rows of a block at most, and bytes of its vectors; rows of the nodes inside it; leaves of a tree, as a power of two; levels from one step of the search to the next.
BLOCK_ROWS, ANCHOR_ROWS, BLOCK_BYTES, NODE_ROWS, MOST_DEPTH, STEP = 8192, 512, 1 << 22, 64, 12, 3
_NODE = "code bigint, parent bigint, centre array<double>, radius double, low double, high double"
_PACK = "rows binary, ids binary, labels binary, vectors binary, needs string"
_FOUND = "row bigint, slot int, vec_id bigint, over int, score bigint, exact string"


def whole_vectors(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part; v: floor(SCALE * x) / SCALE, which doubles hold exactly.  ``row`` tells rows apart."""
    d = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x * SCALE) / float(SCALE)).otherwise(x)  # noqa: E731  larger ones are whole already
    rows = df.where(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & (F.size(vector) > 0) & fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.transform(d, part).alias("v"))


class Planes:
    """A binary tree of planes, as a heap: each cuts its points in halves along their widest direction."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.normal, self.at = np.zeros(((1 << depth) - 1, points.shape[1])), np.zeros((1 << depth) - 1)
        parts = {0: np.arange(len(points))}
        for k in range(len(self.at)):
            of = parts.pop(k, np.arange(0))
            x = points[of]
            self.normal[k] = widest(x)
            side = x @ self.normal[k]
            self.at[k] = np.median(side) if len(of) else 0.0
            parts[2 * k + 1], parts[2 * k + 2] = of[side <= self.at[k]], of[side > self.at[k]]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The number of each point's leaf."""
        k = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            k = 2 * k + 1 + (np.einsum("ij,ij->i", points, self.normal[k]) > self.at[k])
        return k - len(self.at)


def tame(v: np.ndarray) -> np.ndarray:
    """Components small enough to be multiplied; only planes are fitted and asked with them."""
    return np.clip(v, -1e100, 1e100)


def widest(x: np.ndarray) -> np.ndarray:
    """About the direction in which points vary most; zeros if they don't."""
    if len(x) < 2:
        return np.zeros(x.shape[1])
    x = x - x.mean(axis=0)
    top = np.abs(x).max()
    if not top:
        return np.zeros(x.shape[1])
    x = x / top
    d = x[(x * x).sum(axis=1).argmax()]
    for _ in range(5):
        d = x.T @ (x @ d)
        d = d / np.sqrt((d * d).sum())
    return d


def balls(v: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of runs of rows, scaled; a radius is infinite or not a number where floating point can't hold it."""
    with np.errstate(all="ignore"):
        many = np.diff(cuts)
        centre = SCALE * np.add.reduceat(v, cuts[:-1], axis=0) / many[:, None]
        gap = SCALE * v - np.repeat(centre, many, axis=0)
        return centre, np.sqrt(np.maximum.reduceat((gap * gap).sum(axis=1), cuts[:-1]))


def reach(a: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the products of balls (a, r) and (c, s), pair by pair over the leading axes."""
    with np.errstate(all="ignore"):
        mid, na, nc = (a * c).sum(axis=-1), np.sqrt((a * a).sum(axis=-1)), np.sqrt((c * c).sum(axis=-1))
        wide = s * na + r * nc + r * s
        wide = wide + 1e-9 * (na + r) * (nc + s) + 1e-6  # rounding
        return mid - wide, mid + wide


def inner_nodes(v: np.ndarray, rows: int = NODE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of a block, and where its nodes of at most ``rows`` begin (one more at the end)."""
    parts, done, x = [np.arange(len(v))], [], tame(v)
    while parts:
        of = parts.pop()
        if len(of) <= rows:
            done.append(of)
            continue
        side = x[of] @ widest(x[of])
        order = np.argsort(side, kind="stable")
        parts += [of[order[len(of) // 2 :]], of[order[: len(of) // 2]]]
    return np.concatenate(done), np.concatenate([[0], np.cumsum([len(x) for x in done])])


def _whole(v: np.ndarray) -> list[int]:
    return [int(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in v.tolist()]


def products(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Inner products in floating point, and for each row of ``a`` whose products may not be exact there, whole numbers."""
    with np.errstate(all="ignore"):
        x, y = SCALE * a, SCALE * c
        longest = np.sqrt((y * y).sum(axis=1)).max(initial=0)
        exact = np.sqrt((x * x).sum(axis=1)) * longest < EXACT
        wide = {}
        if not exact.all():
            whole = [_whole(z) for z in c]
            for i in np.flatnonzero(~exact).tolist():
                own = _whole(a[i])
                wide[i] = [sum(p * q for p, q in zip(own, z, strict=True)) for z in whole]
            x = np.where(exact[:, None], x, 0)
            y = np.where(np.isfinite(y), y, 0)
        return x @ y.T, wide


def kth(scores: list[int], k: int) -> int | None:
    """The k-th largest, if there are as many."""
    return sorted(scores, reverse=True)[k - 1] if len(scores) >= k else None


class Needs:
    """The ranges of scores that the anchors of a block need: up to ``slots`` each, in whole numbers; (None, None) for none, an open end is None.

    A range is (least, most), both taken, of rows with or without the anchor's label.
    """

    def __init__(self, ranges: list[list[tuple[int | None, int | None] | None]], same: bool, k: int):
        self.ranges, self.same, self.k = ranges, same, k

    def write(self) -> str:
        show = lambda x: "" if x is None else str(x)
        return "\n".join(" ".join("-" if r is None else f"{show(r[0])}:{show(r[1])}" for r in of) for of in self.ranges)

    @classmethod
    def read(cls, text: str, same: bool, k: int) -> Needs:
        num = lambda x: int(x) if x else None
        return cls([[None if r == "-" else tuple(map(num, r.split(":"))) for r in line.split(" ") if r] for line in text.split("\n")], same, k)

    def bounds(self) -> np.ndarray:
        """[slots, anchors, 2] in floating point; least above most where a slot needs nothing."""
        slots = max(map(len, self.ranges), default=0)
        out = np.full((slots, len(self.ranges), 2), [np.inf, -np.inf])
        for i, of in enumerate(self.ranges):
            for j, r in enumerate(of):
                if r is not None:
                    out[j, i] = (-np.inf if r[0] is None else _near(r[0])), (np.inf if r[1] is None else _near(r[1]))
        return out


def _near(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def floors(needs: Needs, ids, labels, v, s_ids, s_labels, s_v) -> Needs:
    """``needs`` with least scores that the sample's k-th best within each range gives."""
    score, wide = products(v, s_v)
    other = s_ids != ids[:, None]
    fit = other & ((s_labels == labels[:, None]) == needs.same)
    out = []
    for i, of in enumerate(needs.ranges):
        new = []
        for r in of:
            if r is not None:
                if i in wide:
                    have = [x for x, f in zip(wide[i], fit[i].tolist(), strict=True) if f]
                else:
                    have = score[i, fit[i]]
                    have = have[(have >= (-np.inf if r[0] is None else r[0])) & (have <= (np.inf if r[1] is None else r[1]))]
                    have = np.partition(have, len(have) - needs.k)[-needs.k :].astype(np.int64).tolist() if len(have) > needs.k else have.astype(np.int64).tolist()
                have = [x for x in have if (r[0] is None or x >= r[0]) and (r[1] is None or x <= r[1])]
                least = kth(have, needs.k)
                r = (r[0] if least is None else least if r[0] is None else max(least, r[0]), r[1])
            new.append(r)
        out.append(new)
    return Needs(out, needs.same, needs.k)


def meet_blocks(a: tuple, needs: Needs, c: tuple, turn=inner_nodes) -> list[tuple[int, int, int, int]]:
    """(anchor's place, slot, candidate's id, score) of the k best of one pair of blocks; a and c: (ids, labels, v)."""
    (a_ids, a_labels, a_v), (c_ids, c_labels, c_v) = a, c
    bounds = needs.bounds()
    (a_order, a_cuts), (c_order, c_cuts) = turn(a_v), turn(c_v)
    a_ball, c_ball = balls(a_v[a_order], a_cuts), balls(c_v[c_order], c_cuts)
    out: list[tuple[int, int, int, int]] = []
    for p in range(len(a_cuts) - 1):
        own = a_order[a_cuts[p] : a_cuts[p + 1]]
        least, most = reach(a_ball[0][p], a_ball[1][p], *c_ball)
        low, high = bounds[:, own, 0].min(initial=np.inf), bounds[:, own, 1].max(initial=-np.inf)
        stay = np.flatnonzero(~((most < low) | (least > high)) & (low < np.inf))
        if not len(stay):
            continue
        of = np.concatenate([c_order[c_cuts[q] : c_cuts[q + 1]] for q in stay])
        score, wide = products(a_v[own], c_v[of])
        fit = (c_ids[of] != a_ids[own][:, None]) & ((c_labels[of] == a_labels[own][:, None]) == needs.same)
        for i, exact in wide.items():
            for j, r in enumerate(needs.ranges[own[i]]):
                if r is not None:
                    have = [(s, int(c_ids[x])) for s, x, f in zip(exact, of.tolist(), fit[i].tolist(), strict=True) if f and (r[0] is None or s >= r[0]) and (r[1] is None or s <= r[1])]
                    out += [(int(own[i]), j, x, s) for s, x in sorted(have, key=lambda y: (-y[0], y[1]))[: needs.k]]
            fit[i] = False
        for j in range(len(bounds)):
            inside = fit & (score >= bounds[j, own, 0][:, None]) & (score <= bounds[j, own, 1][:, None])
            live = np.flatnonzero(inside.any(axis=1))
            if not len(live):
                continue
            held = np.where(inside[live], score[live], -np.inf)
            if held.shape[1] > needs.k:
                inside = inside[live] & (held >= np.partition(held, held.shape[1] - needs.k, axis=1)[:, -needs.k][:, None])
            else:
                inside = inside[live]
            row, col = np.nonzero(inside)
            s, x = held[row, col], c_ids[of[col]]
            order = np.lexsort((x, -s, row))
            row, s, x = row[order], s[order], x[order]
            first = np.searchsorted(row, np.arange(len(live)))
            best = np.arange(len(row)) - first[row] < needs.k
            out += zip(own[live[row[best]]].tolist(), [j] * int(best.sum()), x[best].tolist(), s[best].astype(np.int64).tolist(), strict=True)
    return out


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _open(part: dict, at: int, size: int, side: str) -> tuple:
    """(ids, labels, v) of a packed block."""
    ids, labels, v = (np.frombuffer(part[f"{side}{c}"][at].as_buffer(), t) for c, t in (("ids", "<i8"), ("labels", "<i8"), ("vectors", "<f8")))
    return ids, labels, v.reshape(-1, size)


class Search:
    """The candidates' tree, and what all searches in it share."""

    def __init__(self, vectors: DataFrame, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, sample_rows: int = SAMPLE_ROWS, depth: int | None = None):
        self.rows = materialise(vectors, "vectors")
        n, size = self.rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        self.n, self.size = n, size
        fit = max(1, BLOCK_BYTES // (8 * size))
        self.block_rows, self.anchor_rows = min(block_rows, fit), min(anchor_rows, fit)
        take = max(1, min(sample_rows, SAMPLE_BYTES // (8 * size)))
        sample = self.rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(take).select("vec_id", "label", "v").toArrow()
        self.sample = sample["vec_id"].to_numpy(), sample["label"].to_numpy(), _matrix(sample["v"], size)
        self.most_depth = max(0, min(MOST_DEPTH, int(np.log2(max(1, sample.num_rows // 8)))))
        self.depth = self._depth(n, self.block_rows) if depth is None else min(depth, self.most_depth)
        self.planes = Planes(tame(self.sample[2]), self.most_depth)
        self.candidates = self._tree(self._packed(self.rows, self.depth, self.block_rows, None), self.depth, "candidates")

    def _depth(self, n: int, rows: int) -> int:
        return max(0, min(self.most_depth, int(np.ceil(np.log2(max(1, 2 * n / rows))))))

    def _blocked(self, rows: DataFrame, depth: int, block_rows: int) -> DataFrame:
        """``rows`` plus ``leaf`` and ``block``, of which each has about ``block_rows`` at most."""
        planes, size, shift = self.planes, self.size, self.most_depth - depth

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = planes.leaf(tame(_matrix(batch["v"], size))) >> shift
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        routed = rows.mapInArrow(route, f"{kinds}, leaf bigint")
        counts = np.zeros(1 << depth, np.int64)
        for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # 2 ** MOST_DEPTH rows at most
            counts[r["leaf"]] = r["n"]
        sub, first = _starts(counts, block_rows)

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = batch["leaf"].to_numpy()
                at = first[leaf] + batch["spread"].to_numpy() % sub[leaf]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at)], names=[*batch.schema.names[:-1], "block"])

        spread = F.pmod(F.xxhash64("row"), F.lit(1 << 40)).alias("spread")
        return routed.select("*", spread).mapInArrow(block, f"{kinds}, leaf bigint, block bigint")

    def _packed(self, rows: DataFrame, depth: int, block_rows: int, needs_of) -> DataFrame:
        """A row for each block: its ball, its vectors, and what its anchors need (``needs_of`` gives it; None for candidates)."""
        size = self.size

        def pack(t: pa.Table) -> pa.Table:
            v, ids, labels = _matrix(t["v"], size), t["vec_id"].to_numpy(), t["label"].to_numpy()
            order, _ = inner_nodes(v)
            v, ids, labels = v[order], ids[order], labels[order]
            (centre,), (radius,) = balls(v, np.array([0, len(v)]))
            low, high, text = -np.inf, np.inf, None
            if needs_of is not None:
                needs = needs_of(t.take(pa.array(order)), ids, labels, v)
                b = needs.bounds()
                low, high, text = b[..., 0].min(initial=np.inf), b[..., 1].max(initial=-np.inf), needs.write()
            leaf, block = t["leaf"][0].as_py(), t["block"][0].as_py()
            row = t["row"].to_numpy()[order]
            return pa.table({
                "code": pa.array([block], pa.int64()), "parent": pa.array([leaf], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                "radius": pa.array([float(radius)]), "low": pa.array([float(low)]), "high": pa.array([float(high)]), "rows": pa.array([_bytes(row)], pa.binary()),
                "ids": pa.array([_bytes(ids)], pa.binary()), "labels": pa.array([_bytes(labels)], pa.binary()), "vectors": pa.array([_bytes(v)], pa.binary()), "needs": pa.array([text], pa.string()),
            })

        return self._blocked(rows, depth, block_rows).groupBy("block").applyInArrow(pack, f"{_NODE}, {_PACK}")

    def _tree(self, packed: DataFrame, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
        """Nodes (code, parent, centre, radius, low, high) of each level from the root down to the blocks, and the packed blocks."""
        with arrow_rows(self.rows.sparkSession, 16):
            blocks = materialise(packed, name)

        def cover(t: pa.Table) -> pa.Table:
            c, r = _matrix(t["centre"]), t["radius"].to_numpy()
            with np.errstate(all="ignore"):
                centre = c.mean(axis=0)
                radius = (np.sqrt(((c - centre) ** 2).sum(axis=1)) + r).max()
            if not np.isfinite(radius):
                radius = np.inf
            code = t["parent"][0].as_py()
            return pa.table({
                "code": pa.array([code], pa.int64()), "parent": pa.array([code >> STEP], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([float(radius)]),
                "low": pa.array([min(t["low"].to_pylist())]), "high": pa.array([max(t["high"].to_pylist())]),
            })

        columns = ["code", "parent", "centre", "radius", "low", "high"]
        levels, left = [blocks.select(*columns)], depth
        while True:
            levels.append(materialise(levels[-1].groupBy("parent").applyInArrow(cover, _NODE), f"{name}-nodes"))
            if left <= 0:
                return levels[::-1], blocks
            left -= STEP

    def best(self, anchors: DataFrame, needs_of, same: bool, k: int) -> DataFrame:
        """(row, slot, vec_id, over, score, exact): for each anchor's range the k best candidates of each block that can hold some."""
        depth = self._depth(anchors.count(), self.anchor_rows)
        a_levels, a_blocks = self._tree(self._packed(anchors, depth, self.anchor_rows, needs_of), depth, "anchors")
        c_levels, c_blocks = self.candidates
        top = lambda t, s: t.select(*(F.col(c).alias(f"{s}_{c}") for c in ("code", "centre", "radius", "low", "high")))
        pairs = self._stay(top(a_levels[0], "a").join(top(c_levels[0], "c"), F.col("a_code") == F.col("c_code")))  # the roots, 0 each
        for k_level in range(1, max(len(a_levels), len(c_levels))):
            for s, levels in (("a", a_levels), ("c", c_levels)):
                if k_level < len(levels):
                    down = levels[k_level].withColumnRenamed("parent", f"{s}_of")
                    down = down.select(f"{s}_of", *(F.col(c).alias(f"{s}_{c}") for c in ("code", "centre", "radius", "low", "high")))
                    kept = [c for c in pairs.columns if not c.startswith(f"{s}_") or c == f"{s}_code"]
                    pairs = pairs.select(*kept).withColumnRenamed(f"{s}_code", f"{s}_of").join(down, f"{s}_of").drop(f"{s}_of")
            pairs = self._stay(pairs)
        pairs = materialise(pairs.select("a_code", "c_code"), "pairs")
        size = self.size

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = {c: batch[c] for c in batch.schema.names}
                for at in range(len(batch)):
                    needs = Needs.read(part["a_needs"][at].as_py(), same, k)
                    found = meet_blocks(_open(part, at, size, "a_"), needs, _open(part, at, size, "c_"))
                    if found:
                        own, slot, ids, score = zip(*found, strict=True)
                        rows = np.frombuffer(part["a_rows"][at].as_buffer(), "<i8")[list(own)]
                        over = [(x > _MOST) - (x < _LEAST) for x in score]
                        near = [min(max(x, _LEAST), _MOST) for x in score]
                        exact = [f"{x + _WIDE:0552x}" if o else "" for x, o in zip(score, over, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(slot, pa.int32()), pa.array(ids, pa.int64()), pa.array(over, pa.int32()), pa.array(near, pa.int64()), pa.array(exact, pa.string())], names=["row", "slot", "vec_id", "over", "score", "exact"])

        packed = lambda t, s: t.select(*(F.col(c).alias(f"{s}_{c}") for c in ("code", "rows", "ids", "labels", "vectors", "needs")))
        both = pairs.join(packed(a_blocks, "a"), "a_code").join(packed(c_blocks, "c").drop("c_rows", "c_needs"), "c_code")
        with arrow_rows(self.rows.sparkSession, 4):  # a row holds two blocks
            return materialise(both.mapInArrow(meet, _FOUND), "found")

    @staticmethod
    def _stay(pairs: DataFrame) -> DataFrame:
        """The pairs of nodes whose products can lie in a range that is needed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    least, most = reach(_matrix(batch["a_centre"]), batch["a_radius"].to_numpy(), _matrix(batch["c_centre"]), batch["c_radius"].to_numpy())
                    low, high = batch["a_low"].to_numpy(), batch["a_high"].to_numpy()
                    yield batch.filter(pa.array(~((most < low) | (least > high)) & (low < np.inf)))

        return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("over"), F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, vector: str = "embedding", label: str = "label", **tree: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row whose id ``every`` divides.

    A negative's score is ``low`` to ``high`` hundredths of its positive's.
    """
    search = Search(whole_vectors(vectors, vector, label), **tree)
    sample = search.sample
    anchors = search.rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def every_score(t: pa.Table, ids, labels, v) -> Needs:
        return floors(Needs([[(None, None)]] * len(ids), True, positives), ids, labels, v, *sample)

    found = _ranked(search.best(anchors, every_score, True, positives), positives)
    found = materialise(found.select("row", F.col("rank").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "exact"), "positives")
    known = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_score", "exact"))).alias("known"))  # ``positives`` of them at most

    def windows(t: pa.Table, ids, labels, v) -> Needs:
        ranges = []
        for of in t["known"].to_pylist():
            score = [int(x["exact"], 16) - _WIDE if x["exact"] else x["positive_score"] for x in of]
            ranges.append([(-(-low * p // 100), high * p // 100) if p >= 0 else None for p in score])
        return floors(Needs(ranges, False, negatives), ids, labels, v, *sample)

    with_positives = anchors.join(known, "row")
    out = _ranked(search.best(with_positives, windows, False, negatives), negatives)
    out = out.select("row", (F.col("slot") + 1).alias("turn"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(found.drop("exact"), ["row", "turn"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
