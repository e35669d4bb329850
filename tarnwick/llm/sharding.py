"""Sharding by histogram sort: equal bytes in every shard, one exchange of the rows.

Rows are ordered by a hash of the text and, within equal texts, by a hash of the id, written as
hexadecimal digits.  A round counts the exact bytes and rows below each of a set of candidate
boundaries (prefixes of keys) on all partitions; the next round probes only the intervals in which
a splitter still lies, with finer boundaries, until every splitter is within the tolerance.  Then
all rows move once.  Shards are cut into subranges, so that no task gets a whole shard; the counts
below the splitters give each subrange its place, and so gapless slots.

Equal texts stand next to each other and lie in one shard: a boundary of shards goes to the nearer end of the group it falls in, even
beyond the tolerance.  Only a group of more bytes than a shard is split, by id; subranges inside a shard may split any group.  What the driver gets in
a round is bounded by the number of splitters times the digits' values, not by the rows.

Cases: columns named like the result's give way to them.  A null text counts as an empty one; a null id is a value like any other.  Rows that agree
in text and id stay in one shard, in any order.  An empty table gives an empty result; fewer rows
than shards leave shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialise

TEXT_DIGITS, ID_DIGITS = 12, 16
FIRST_DIGITS, NEXT_DIGITS = 3, 2
SUBRANGE_BYTES, MOST_SUBRANGES = 1 << 25, 256
AFTER = "g"  # sorts after every hexadecimal digit


@dataclass(frozen=True)
class Splitter:
    """Keys from ``key`` on lie above it; ``size`` and ``rows`` are the exact sums of those below."""

    key: str
    size: int
    rows: int


def sort_key(text: Column, doc_id: Column) -> Column:
    """Digits of the text's hash, then digits of the id's."""
    digits = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))
    return F.concat(F.substring(digits(text), 1, TEXT_DIGITS), F.substring(digits(doc_id), 1, ID_DIGITS))


def find_splitters(keys: DataFrame, parts: int, tolerance: float, subranges: int = 1) -> list[Splitter]:
    """``parts - 1`` splitters of ``keys`` (key, size) into runs of equal size, each within ``tolerance`` of its target.

    Every ``subranges``-th bounds a shard, and splits no group of equal texts that is not larger than a shard.
    """
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = [total * k / parts for k in range(1, parts)]
    found: dict[int, Splitter] = {}
    # of each open splitter: the prefix of the interval it lies in, and the sums below that interval
    at = {k: ("", 0, 0) for k in range(len(targets))}
    length, full = 0, TEXT_DIGITS + ID_DIGITS
    while at:
        more = min(full if length >= TEXT_DIGITS else TEXT_DIGITS, length + (NEXT_DIGITS if length else FIRST_DIGITS))
        probed = keys.where(F.substring("key", 1, length).isin(sorted({p for p, _, _ in at.values()}))) if length else keys
        counts = probed.groupBy(F.substring("key", 1, more).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).toPandas()
        counts = counts.sort_values("p", ignore_index=True)
        if not len(counts):
            return [Splitter(AFTER, total, rows)] * len(targets)
        name = counts["p"].to_numpy()
        size, number = (np.concatenate([[0], np.cumsum(counts[c].to_numpy(dtype=np.int64))]) for c in ("s", "n"))
        still = {}
        for k, (prefix, below, below_rows) in at.items():
            lo, hi = np.searchsorted(name, [prefix, prefix + AFTER])
            here = below + size[lo : hi + 1] - size[lo]
            i = lo + min(max(int(np.searchsorted(here, targets[k], side="right")) - 1, 0), hi - lo - 1)
            edges = [(name[i], i), (name[i] + AFTER, i + 1)]
            near = min(edges, key=lambda e: abs(below + size[e[1]] - size[lo] - targets[k]))
            s, n = int(below + size[near[1]] - size[lo]), int(below_rows + number[near[1]] - number[lo])
            of_shard = (k + 1) % subranges == 0
            whole = of_shard and more == TEXT_DIGITS and size[i + 1] - size[i] <= total * subranges / parts
            # the ends of an interval of text digits are ends of groups; of id digits only where the group is too large
            if abs(s - targets[k]) <= tolerance or whole or more == full:
                found[k] = Splitter(near[0], s, n)
            else:
                still[k] = (name[i], int(below + size[i] - size[lo]), int(below_rows + number[i] - number[lo]))
        at, length = still, more
    for k in range(len(targets)):  # a shard's bound may have gone past the bounds inside
        if (k + 1) % subranges:
            low, high = found.get(k - k % subranges - 1), found.get(k - k % subranges + subranges - 1)
            if low and found[k].key < low.key:
                found[k] = low
            if high and found[k].key > high.key:
                found[k] = high
    return [found[k] for k in range(len(targets))]


def histogram_sort(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = 24, subranges: int | None = None, tolerance: float = 0.001) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard``, ``subrange`` and ``slot`` (its place in the shard, from 0).

    A row's size is the bytes of its text plus 8; ``tolerance`` is a share of the mean shard size.  ``subranges`` of a shard are
    sorted by tasks of their own: unless given, as many as make them about ``SUBRANGE_BYTES``, ``MOST_SUBRANGES`` at most.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    key = sort_key(F.coalesce(F.col(text), F.lit("")), F.col(doc_id))
    keys = materialise(df.select(key.alias("key"), size.alias("size")), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    subranges = subranges or max(1, min(MOST_SUBRANGES, -(-total // (shards * SUBRANGE_BYTES))))
    parts = shards * subranges
    splitters = find_splitters(keys, parts, tolerance * total / shards, subranges)
    bounds = np.array([s.key for s in splitters], dtype="S32")
    if len(bounds) and (np.diff([s.rows for s in splitters]) < 0).any():
        raise AssertionError("splitters out of order")

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy().astype("S32"), side="right").astype(np.int32))

    first = [0, *(s.rows for s in splitters)]  # rows before each subrange
    before = [first[k] - first[k - k % subranges] for k in range(parts)]
    moved = df.drop("shard", "subrange", "slot").withColumn("__key", key).withColumn("__part", part_of("__key")).repartitionById(parts, "__part")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    offset = F.element_at(F.array(*map(F.lit, before)), F.col("__part") + 1)
    return (
        moved.withColumn("slot", place.cast("bigint") - 1 + offset)
        .withColumn("shard", F.floor(F.col("__part") / subranges).cast("int"))
        .withColumnRenamed("__part", "subrange").drop("__key")
    )
