"""Running totals, row numbers and trailing frames over rows in one order, where no task holds the order, or a key, whole.

Rows are dealt to ranges of the total order (keys, then order) of about ``RANGE_ROWS`` rows.  A range is sorted by a task of its own; what stands before
it comes from the sums of the ranges, a table with a row for each range and key.  Beyond ``MOST_RANGES`` ranges these sums
are summed in the same way, so that no task has more rows than a range.  Frames of the last ``width`` rows use blocks of equal
size, cut by row number, to which the last rows of the block before are sent too.

Rows that agree in keys and order stand in the order of a hash of all their columns, so that even they can be cut between ranges and a
result doesn't depend on partitioning.  Input is written once: it is read for its size, its ranges' bounds and its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import written

RANGE_ROWS, MOST_RANGES = 1 << 18, 1 << 16
RANGE, TIE, AT, BLOCK, HOME = "__range", "__tie", "__at", "__block", "__home"

Order = str | Column


def ranged(rows: DataFrame, order: tuple[Order, ...], keys: tuple[str, ...] = (), range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """``rows`` plus ``__tie`` and ``__range``, which ascends with keys, order and tie; and how many ranges there are."""
    plain = [f.name for f in rows.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = written(rows.withColumn(TIE, F.xxhash64(*(F.col(f"`{c}`") for c in plain))), "ordered")
    n = max(1, -(-rows.count() // range_rows))
    if n == 1:
        return rows.withColumn(RANGE, F.lit(0)), 1
    # bounds are sampled, and differ between evaluations: the ranges are written too
    return written(rows.repartitionByRange(n, *keys, *order, TIE).withColumn(RANGE, F.spark_partition_id()), "ranges"), n


def joined(rows: DataFrame, other: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """``rows`` with the further columns of ``other``, whose rows have different ``on``; nulls are equal."""
    names = {c: f"__of_{k}" for k, c in enumerate(on)}
    other = other.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in on]
    out = rows.join(other, on=same, how="left") if same else rows.crossJoin(other)
    return out.drop(*names.values())


def _before(totals: DataFrame, names: list[str], keys: tuple[str, ...], ranges: int, most: int) -> DataFrame:
    """``totals`` (keys, __range, names) with the sums of the ranges before in place of their own."""
    order = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    if ranges <= most:
        return totals.withColumns({c: F.coalesce(F.sum(c).over(order), F.lit(0)) for c in names})
    group = F.floor(F.col(RANGE) / most).cast("int")
    totals = written(totals.withColumn("__group", group), "totals")
    groups = totals.groupBy(*keys, F.col("__group").alias(RANGE)).agg(*(F.sum(c).alias(c) for c in names))
    above = _before(groups, names, keys, -(-ranges // most), most).withColumnsRenamed({RANGE: "__group", **{c: f"__above_{k}" for k, c in enumerate(names)}})
    inside = Window.partitionBy(*keys, "__group").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    out = totals.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in names})
    out = joined(out, above, (*keys, "__group"))
    return out.withColumns({c: F.col(c) + F.col(f"__above_{k}") for k, c in enumerate(names)}).drop("__group", *(f"__above_{k}" for k in range(len(names))))


def _running(rows: DataFrame, sums: dict[str, Order], order: tuple[Order, ...], keys: tuple[str, ...], range_rows: int, most_ranges: int) -> DataFrame:
    ranges, n = ranged(rows, order, keys, range_rows)
    value = lambda v: F.col(v) if isinstance(v, str) else v
    within = Window.partitionBy(*keys, RANGE).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.withColumns({c: F.coalesce(F.sum(value(v)).over(within), F.lit(0)) for c, v in sums.items()})
    if n == 1:
        return out
    names = {c: f"__sum_{k}" for k, c in enumerate(sums)}
    totals = ranges.groupBy(*keys, RANGE).agg(*(F.coalesce(F.sum(value(v)), F.lit(0)).alias(names[c]) for c, v in sums.items()))
    out = joined(out, _before(totals, list(names.values()), keys, n, most_ranges), (*keys, RANGE))
    return out.withColumns({c: F.col(c) + F.col(s) for c, s in names.items()}).drop(*names.values())


def running_sums(rows: DataFrame, sums: dict[str, Order], order: tuple[Order, ...], keys: tuple[str, ...] = (), range_rows: int = RANGE_ROWS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """``rows`` plus, under each name of ``sums``, the total of a column over the rows of its key up to and with it; nulls count as 0."""
    return _running(rows, sums, order, keys, range_rows, most_ranges).drop(RANGE, TIE)


def numbered(rows: DataFrame, order: tuple[Order, ...], keys: tuple[str, ...] = (), name: str = AT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` plus ``name``, a row's number in its key, from 0."""
    out = _running(rows, {name: F.lit(1)}, order, keys, range_rows, MOST_RANGES)
    return out.withColumn(name, F.col(name) - 1).drop(RANGE, TIE)


def blocks(rows: DataFrame, order: tuple[Order, ...], keys: tuple[str, ...], size: int, halo: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` plus ``__at``, ``__home`` and ``__block``: runs of ``size`` rows of a key; the last ``halo`` of each stand in the next block too.

    A row stands at home where ``__block`` is its ``__home``; ``halo`` is ``size`` at most.
    """
    if halo > size:
        raise ValueError("a halo reaches over one block only")
    out = numbered(rows, order, keys, range_rows=range_rows).withColumn(HOME, F.floor(F.col(AT) / size))
    if not halo:
        return out.withColumn(BLOCK, F.col(HOME))
    both = F.when(F.col(AT) % size >= size - halo, F.array(HOME, F.col(HOME) + 1)).otherwise(F.array(HOME))
    return out.withColumn(BLOCK, F.explode(both))
