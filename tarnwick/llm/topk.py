"""Exact top-k inner products with vectors taken in descending order of length.

Each component x becomes floor(1024 * x); scores are exact integer inner products.  Vectors are cut into
blocks by ranges of their Euclidean length, the longest first, and rotated by the singular vectors
of the table, so that the leading coordinates hold most of a product.  The longest vectors of all are met first: the k-th
score there, over the query's length, is the length that a vector needs to matter (Cauchy-Schwarz), and a query goes only to the
blocks that hold such vectors; queries that need about as many blocks share a block of their own.  Within a meeting
a query walks down the block in steps: it stops where its length times the next vector's is below its k-th score so far,
and of a step's vectors it computes the exact product only for those whose
partial sum over the leading coordinates plus the product of the residual lengths reaches it.

Products whose lengths allow 2 ** 53 or more are computed in whole numbers of any size.  A score beyond 64 bits is
given as the nearest 64-bit number, ranks follow the exact one.

Cases: a vector that is null, or holds a null, NaN or infinite component, takes no part; neither does an
empty one.  Vectors of different lengths are compared over their common components.  Rows that
repeat a ``vec_id`` are candidates each, a query is answered once for each of its rows' distinct
vectors, and a query's own ``vec_id`` is never its candidate.  Ties go to the smaller ``vec_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialise

SCALE = 1024
LEADING = 16
STEP = 256
RANGES = 1024
EXACT = float(1 << 53)  # whole numbers below it are exact in floating point
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_WIDE = 1 << 2200  # larger than any product of two finite vectors
_FOUND = "query_id bigint, q_key bigint, vec_id bigint, over int, score bigint, exact string"


def integer_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, length): components as floor(1024 * x) / 1024, which doubles hold exactly, and 1024 times their Euclidean length."""
    d = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), d.alias("d")).where(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & fine)
    # a double of 2 ** 42 or more is a whole number of 1024ths already
    part = lambda x: F.when(F.abs(x) < float(1 << 42), F.floor(x * SCALE) / float(SCALE)).otherwise(x)
    v = rows.select("vec_id", F.transform("d", part).alias("v"))
    return v.withColumn("length", SCALE * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    """The rows of a list column, filled up with zeros to ``size`` or the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    flat, many = column.values.to_numpy(), np.diff(off)
    size = size or int(many.max(initial=0))
    if (many == size).all():
        return flat[off[0] : off[-1]].reshape(len(many), size)
    out = np.zeros((len(many), size))
    inside = np.arange(size) < many[:, None]
    out[inside] = flat[off[0] : off[-1]]
    return out


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of the table, largest first, from the summed Gram matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            m = _matrix(batch["v"])
            if m.shape[1] > len(total):
                total = np.pad(total, (0, m.shape[1] - len(total)))
            total[: m.shape[1], : m.shape[1]] += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["gram"])

    # a part of the sum from each of a fixed number of tasks: 64 matrices, dimensions squared
    parts = vectors.select("v").coalesce(64).mapInArrow(run, "gram array<double>").toArrow()["gram"].to_pylist()
    size = max([0, *(int(len(x) ** 0.5) for x in parts)])
    gram = np.zeros((size, size))
    for x in parts:
        n = int(len(x) ** 0.5)
        gram[:n, :n] += np.array(x).reshape(n, n)
    return np.linalg.eigh(gram)[1][:, ::-1] if size else np.zeros((0, 0))


def _whole(v: np.ndarray) -> list[int]:
    """1024 times each component, as whole numbers."""
    return [int(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in v.tolist()]


def _lengths(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return SCALE * np.sqrt((v * v).sum(axis=1))


class Best:
    """The k best candidates of each query: scores as floating point while these are exact, else as whole numbers."""

    def __init__(self, n: int, k: int):
        self.k, self.ids = k, np.full((n, k), np.iinfo(np.int64).max)
        self.score = np.full((n, k), -np.inf)
        self.wide: dict[int, list[tuple[int, int]]] = {}

    def limit(self, live: np.ndarray) -> np.ndarray:
        return self.score[live, -1]

    def add(self, live: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[live], score], axis=1)
        ids = np.concatenate([self.ids[live], np.broadcast_to(ids, (len(live), len(ids)))], axis=1)
        top = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[live], self.ids[live] = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)

    def add_exactly(self, row: int, found: list[tuple[int, int]]) -> None:
        """``found``: (score, vec_id) of one query, in whole numbers of any size."""
        old = self.wide.get(row)
        if old is None:
            old = [(int(s), int(i)) for s, i in zip(self.score[row].tolist(), self.ids[row].tolist(), strict=True) if s > -np.inf]
        self.wide[row] = best = sorted([*old, *found], key=lambda x: (-x[0], x[1]))[: self.k]
        self.score[row] = -np.inf
        self.score[row, : len(best)] = [_below(s) for s, _ in best]  # for limits only
        self.ids[row, : len(best)] = [i for _, i in best]

    def rows(self) -> tuple[np.ndarray, list[int], list[int]]:
        """Query numbers, ids and exact scores."""
        row, col = np.nonzero(self.score > -np.inf)
        exact = [self.wide[r][c][0] if r in self.wide else int(self.score[r, c]) for r, c in zip(row.tolist(), col.tolist(), strict=True)]
        return row, self.ids[row, col].tolist(), exact


def _below(x: int) -> float:
    """A floating-point number not above ``x``."""
    try:
        y = float(x)
    except OverflowError:
        return float(np.finfo(float).max) if x > 0 else -float(np.finfo(float).max)
    return y if int(y) <= x else float(np.nextafter(y, -np.inf))


def search_block(q_ids, q, floor, v_ids, v, k: int, turn: np.ndarray) -> Best:
    """The k best of the rows of ``v`` for each row of ``q``.  ``floor``: a score for each query that k vectors elsewhere are known to reach."""
    v_len, q_len = _lengths(v), _lengths(q)
    order = np.lexsort((v_ids, -v_len))
    v, v_ids, v_len = v[order], v_ids[order], v_len[order]
    best = Best(len(q), k)
    with np.errstate(invalid="ignore"):
        small = q_len * v_len.max(initial=0) < EXACT  # false too where a length is beyond floating point
    for i in np.flatnonzero(~small):
        _search_exactly(int(i), q_ids[i], q[i], floor[i], v_ids, v, v_len, best)
    live = np.flatnonzero(small)
    if not len(live):
        return best
    q, v = q * SCALE, v * SCALE
    rq, rv = q @ turn, v @ turn
    rest_q = np.sqrt((rq[:, LEADING:] ** 2).sum(axis=1))
    rest_v = np.sqrt((rv[:, LEADING:] ** 2).sum(axis=1))
    for at in range(0, len(v), STEP):
        limit = np.maximum(best.limit(live), floor[live])
        slack = 1e-9 * (q_len[live] * v_len[at]) + 1e-6  # rounding of the float bounds
        live, limit, slack = (x[q_len[live] * v_len[at] + slack >= limit] for x in (live, limit, slack))
        if not len(live):
            break
        part = slice(at, at + STEP)
        bound = rq[live, :LEADING] @ rv[part, :LEADING].T + np.outer(rest_q[live], rest_v[part]) + slack[:, None]
        maybe = bound >= limit[:, None]
        cols = np.flatnonzero(maybe.any(axis=0))
        if not len(cols):
            continue
        exact = np.where(maybe[:, cols], q[live] @ v[at + cols].T, -np.inf)  # whole numbers below 2 ** 53: exact
        exact[q_ids[live][:, None] == v_ids[at + cols]] = -np.inf
        best.add(live, exact, v_ids[at + cols])
    return best


def _search_exactly(row: int, q_id: int, q: np.ndarray, floor: float, v_ids, v, v_len, best: Best) -> None:
    """One query in whole numbers, down the vectors by length."""
    own, length = _whole(q), float(_lengths(q[None])[0])
    for at in range(0, len(v), STEP):
        limit = max(float(best.limit(np.array([row]))[0]), floor)
        reach = length * float(v_len[at]) if length else 0.0
        if np.isfinite(reach) and reach * (1 + 1e-9) + 1e-6 < limit:
            break
        part = [(sum(a * b for a, b in zip(own, _whole(x), strict=True)), int(i)) for i, x in zip(v_ids[at : at + STEP], v[at : at + STEP], strict=True) if i != q_id]
        best.add_exactly(row, part)


def _starts(counts: np.ndarray, at_most: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many blocks of about ``at_most`` rows each range of ``counts`` rows is cut, and the number of its first (one more at the end)."""
    sub = np.maximum(1, -(-counts // at_most)).astype(np.int64)
    return sub, np.concatenate([[0], np.cumsum(sub)])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block_rows: int = 8192, query_rows: int = 8192, head_rows: int = 4096, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id ``every`` divides.

    The ``head_rows`` longest vectors are sent to every task, which bounds their size; all else
    meets in blocks of about ``block_rows`` vectors and ``query_rows`` queries.  The driver sees counts of at most ``RANGES``
    ranges of lengths and of queries.
    """
    rows = materialise(integer_vectors(vectors, vector), "vectors")
    usual = rows.where(F.col("length") < EXACT**0.5)
    turn = rotation(usual)
    n = rows.count()
    size = max(len(turn), rows.agg(F.max(F.size("v"))).first()[0] or 0)
    turn = np.pad(turn, (0, size - len(turn)))
    turn[range(size - 1, -1, -1), range(size - 1, -1, -1)] += (np.abs(turn).sum(axis=0) == 0) * 1.0  # components of long vectors alone stay as they are
    head = rows.orderBy(F.desc("length"), "vec_id").limit(head_rows).select("vec_id", "v").toArrow()
    head_ids, head_v = head["vec_id"].to_numpy(), _matrix(head["v"], size)

    # ranges of falling length, cut into blocks
    ranges = max(1, min(RANGES, -(-n // block_rows)))
    cuts = rows.agg(F.percentile_approx("length", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    cuts = -np.unique(np.array(cuts or [], float))[::-1]  # as negative lengths, ascending

    def in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(cuts, -batch["length"].to_numpy(), side="left"))], names=[*batch.schema.names, "r"])

    ranged = rows.mapInArrow(in_range, "vec_id bigint, v array<double>, length double, r bigint")
    seen = ranged.groupBy("r").agg(F.count("*").alias("n"), F.max("length").alias("top")).toPandas().set_index("r")
    counts, top = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1)
    counts[seen.index], top[seen.index] = seen["n"], seen["top"]
    sub, first = _starts(counts, block_rows)

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor, ids, q = np.full(len(batch), -np.inf), batch["vec_id"].to_numpy(), _matrix(batch["v"], size)
            for at in range(0, len(batch), 512):
                part = slice(at, at + 512)
                floor[part] = search_block(ids[part], q[part], floor[part], head_ids, head_v, k, turn).score[:, -1]
            length = _lengths(q)
            with np.errstate(all="ignore"):
                needed = (floor - 1e-6) / length * (1 - np.sign(floor) * 2e-9)  # the length that a vector must have to matter
            needed = np.where(np.isfinite(needed) & np.isfinite(length) & (length > 0), needed, -np.inf)
            last = np.searchsorted(-top, -needed, side="right")  # ranges from the longest on
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(last)], names=["vec_id", "v", "floor", "ranges"])

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").distinct()
    queries = materialise(asked.mapInArrow(with_floor, "vec_id bigint, v array<double>, floor double, ranges bigint"), "queries")
    # queries that need about as many ranges form a class, cut into blocks
    needs = queries.where("ranges > 0").groupBy("ranges").agg(F.count("*").alias("n")).orderBy("ranges").toPandas()
    ends, sizes, held = [], [], 0
    for last, many in zip(needs["ranges"], needs["n"], strict=True):
        held += many
        if held >= query_rows or last == needs["ranges"].iloc[-1]:
            ends.append(int(last))
            sizes.append(held)
            held = 0
    ends_, (q_sub, q_first) = np.array(ends, np.int64), _starts(np.array(sizes, np.int64), query_rows)

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query once for each block of vectors that it needs."""
        for batch in batches:
            last = batch["ranges"].to_numpy()
            of = np.searchsorted(ends_, last)
            qb = q_first[of] + batch["spread"].to_numpy() % q_sub[of]
            for a in range(0, len(batch), 256):
                many = first[last[a : a + 256]]
                take = np.repeat(np.arange(a, a + len(many)), many)
                vb = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                part = pa.array(take)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(part), batch["v"].take(part), batch["floor"].take(part), batch["q_key"].take(part), pa.array(qb[take]), pa.array(vb)], names=["vec_id", "v", "floor", "q_key", "qb", "vb"])

    def to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector once for each block of queries that needs its range."""
        for batch in batches:
            r = batch["r"].to_numpy()
            vb = first[r] + batch["spread"].to_numpy() % sub[r]
            least = q_first[np.searchsorted(ends_, r, side="right")]  # classes that end beyond the range
            for a in range(0, len(batch), 1024):
                many = q_first[-1] - least[a : a + 1024]
                take = np.repeat(np.arange(a, a + len(many)), many)
                qb = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + least[take]
                part = pa.array(take)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(part), batch["v"].take(part), pa.array(qb), pa.array(vb[take])], names=["vec_id", "v", "qb", "vb"])

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("spread")
    left = queries.where("ranges > 0").select("vec_id", "v", "floor", "ranges", F.xxhash64("v").alias("q_key"), spread)
    left = left.mapInArrow(to_vectors, "vec_id bigint, v array<double>, floor double, q_key bigint, qb bigint, vb bigint")
    right = ranged.select("vec_id", "v", "r", spread).mapInArrow(to_queries, "vec_id bigint, v array<double>, qb bigint, vb bigint")

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if q.num_rows and v.num_rows:
            ids, mat, floor, key = q["vec_id"].to_numpy(), _matrix(q["v"], size), q["floor"].to_numpy(), q["q_key"].to_numpy()
            v_ids, v_mat = v["vec_id"].to_numpy(), _matrix(v["v"], size)
            for at in range(0, len(ids), 512):
                part = slice(at, at + 512)
                row, found, score = search_block(ids[part], mat[part], floor[part], v_ids, v_mat, k, turn).rows()
                over = [(x > _MOST) - (x < _LEAST) for x in score]
                near = [min(max(x, _LEAST), _MOST) for x in score]
                exact = [f"{x + _WIDE:0552x}" if o else "" for x, o in zip(score, over, strict=True)]
                for have, more in zip(out, (ids[part][row].tolist(), key[part][row].tolist(), found, over, near, exact), strict=True):
                    have += more
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["query_id", "q_key", "vec_id", "over", "score", "exact"])

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "q_key").orderBy(F.desc("over"), F.desc("score"), F.desc("exact"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
