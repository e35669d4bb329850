"""Packing documents into sequences by column generation for the cutting-stock problem.

A document's ids are cut at every ``capacity`` ids.  The lengths of the pieces, in units of ``unit`` ids,
make a histogram of ``capacity / unit`` classes: all that the driver sees.  A linear program
chooses how often each pattern (a number of pieces of each class that fit one sequence) is used; new
patterns are priced by a knapsack dynamic program over the dual values until none improves the program.  Numbers of
uses are rounded down, what is left is packed first-fit-decreasing, and pieces are dealt to the patterns' places
by their rank within their class.

Pieces shorter than ``SHORT`` ids would lose much by rounding: neighbours of them are first put into bundles of about
``BUNDLE`` ids, which are packed as one.

Ranks come from counts of blocks of bounded size, so no class has to fit a task.

Cases: a null or empty text is its end id alone.  Repeated rows are packed each.  A null ``doc_id`` is a
value like any other.  An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialise
from .subwords import shared_encoder
from .textbuf import binary

CAPACITY, UNIT, END_ID = 2048, 8, 1
SHORT, BUNDLE = 64, 250
RANK_BLOCK = 100_000


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (piece, doc_id, start, length, doc_tokens, ids).

    ``ids``: little-endian unsigned 32-bit; ``piece`` is unique within one run.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, ids, off in encoder.column(batch["text"]):
                ends = off + np.arange(len(off))  # of each text, with its end id
                out = np.full(ends[-1], END_ID, "<u4")
                inside = np.ones(len(out), bool)
                inside[ends[1:] - 1] = False
                out[inside] = ids
                total = np.diff(ends)
                many = -(-total // capacity)
                of = np.repeat(np.arange(len(total)), many)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                n = len(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(serial, serial + n)), batch["doc_id"].take(pa.array(at + of)), pa.array(start),
                        pa.array(np.minimum(capacity, total[of] - start)), pa.array(total[of]), binary(out, np.append(ends[of] + start, len(out))),
                    ],
                    names=["piece", "doc_id", "start", "length", "doc_tokens", "ids"],
                )
                serial += n

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"piece bigint, doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits ``capacity``: its value, and how often it holds each item."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], -1
        fit = int(np.searchsorted(sizes, c, side="right"))
        if fit:
            gain = values[:fit] + best[c - sizes[:fit]]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], choice[c] = gain[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns [m, classes] and their fractional uses that cover ``demand`` with the fewest sequences."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    uses = inverse @ demand
    for _ in range(max_rounds):
        dual = inverse.sum(axis=0)
        value, new = knapsack(dual, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        move = inverse @ new
        ratio = np.where(move > 1e-9, uses / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        patterns[out] = new
        step = ratio[out]
        uses = np.maximum(uses - step * move, 0)
        uses[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        if not m:
            break
    return patterns, uses


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, whole number of uses) pairs whose places cover ``demand`` (pieces of each size)."""
    if not len(sizes):
        return []
    patterns, uses = column_generation(sizes, demand.astype(float), capacity)
    out, left = [], demand.astype(np.int64).copy()
    for p, x in zip(patterns, uses, strict=True):
        n = int(x + 1e-6)
        if n:
            out.append((p, n))
            left -= n * p
    left = np.maximum(left, 0)
    while left.any():  # first-fit-decreasing of what rounding left over
        room, p = capacity, np.zeros(len(sizes), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            n = min(int(left[k]), room // int(sizes[k]))
            p[k], room = n, room - n * int(sizes[k])
        times = int((left[p > 0] // p[p > 0]).min())
        out.append((p, times))
        left -= times * p
    return out


def bundles(pieces: DataFrame, short: int = SHORT, bundle: int = BUNDLE, rank_block: int = RANK_BLOCK) -> DataFrame:
    """``pieces`` plus ``item``: what a piece is packed with, itself or the first of its bundle of short pieces."""
    small = pieces.where(F.col("length") < short)
    blocks = max(1, -(-small.count() // rank_block))
    small = small.withColumn("__block", F.pmod(F.xxhash64("piece"), F.lit(blocks)))
    before = F.sum("length").over(Window.partitionBy("__block").orderBy("piece")) - F.col("length")
    small = small.withColumn("__bundle", F.floor(before / bundle))
    small = small.withColumn("item", F.min("piece").over(Window.partitionBy("__block", "__bundle"))).drop("__block", "__bundle")
    return pieces.where(F.col("length") >= short).withColumn("item", F.col("piece")).unionByName(small)


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, rank_block: int = RANK_BLOCK) -> DataFrame:
    """``pieces`` (piece, length, and any other columns) plus ``sequence_id`` and ``offset``.

    ``pieces`` must be a written table: it is read for the histogram and again for the ranks.
    """
    bundled = bundles(pieces, min(SHORT, capacity // 8), min(BUNDLE, capacity // 8), rank_block)
    items = materialise(bundled.groupBy("item").agg(F.sum("length").alias("length")), "items")
    placed = pack_items(items, capacity, unit, rank_block)
    order = Window.partitionBy("sequence_id").orderBy("place", "piece")
    out = bundled.join(placed.select("item", "sequence_id", "place"), "item")
    return out.withColumn("offset", F.sum("length").over(order) - F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack_items(pieces: DataFrame, capacity: int, unit: int, rank_block: int) -> DataFrame:
    """(item, sequence_id, place) of ``pieces`` (item, length): where the patterns put them.  No class has 2 ** 44 pieces."""
    sized = pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["class"]: r["n"] for r in sized.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most capacity / unit rows
    sizes = np.array(sorted(histogram), np.int64)
    patterns = plan(sizes, np.array([histogram[s] for s in sizes], np.int64), capacity // unit)
    places, taken, first = [], dict.fromkeys(histogram, 0), 0
    for p, uses in patterns:
        at = 0
        for k in np.argsort(-sizes):
            if n := int(p[k]):
                size = int(sizes[k])
                places.append((size, taken[size], taken[size] + n * uses, n, first, at))
                taken[size] += n * uses
                at += n
        first += uses
    # where a class's ranks change pattern: a row for each class of each pattern, capacity / unit squared at most
    cut = np.array(sorted(places), np.int64).reshape(-1, 6)
    of_class, lo, each, start, at = cut[:, 0], cut[:, 1], cut[:, 3], cut[:, 4], cut[:, 5]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            k = np.searchsorted((of_class << 44) | lo, (batch["class"].to_numpy().astype(np.int64) << 44) | rank, side="right") - 1
            turn, place = np.divmod(rank - lo[k], each[k])
            yield pa.RecordBatch.from_arrays([batch["item"], pa.array(start[k] + turn), pa.array(at[k] + place)], names=["item", "sequence_id", "place"])

    blocks = max(1, -(-sum(histogram.values()) // rank_block))
    ranked = sized.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    counts = ranked.groupBy("class", "block").agg(F.count("*").alias("n"))
    before = counts.select("class", "block", (F.sum("n").over(Window.partitionBy("class").orderBy("block")) - F.col("n")).alias("before"))
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("class", "block").orderBy("item")))
    ranked = ranked.join(before, ["class", "block"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    return ranked.select("item", "class", F.col("rank").cast("bigint").alias("rank")).mapInArrow(deal, "item bigint, sequence_id bigint, place bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The pieces with their ids are written in the shared folder; only their digests are dealt out here.
    """
    pieces = materialise(tokenise(docs, tokenizer), "pieces")
    light = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(light).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
