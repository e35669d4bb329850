"""Samples, orders and batches that depend on keys and seeds, never on partitioning."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordered


def stratified_sample(rows: DataFrame, n: int, seed: int, label: str = "label", key: str = "id") -> DataFrame:
    """The ids (distinct) of ``n`` rows of each class, all of a class with fewer; ``label`` may be an array of classes."""
    long = rows.select(key, F.explode(label).alias("__c")) if rows.schema[label].dataType.typeName() == "array" else rows.select(key, F.col(label).alias("__c"))
    w = Window.partitionBy("__c").orderBy(F.xxhash64(F.lit(seed), "__c", key), key)
    return long.distinct().withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).select(key).distinct()


def uniform_sample(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows without replacement, or all."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def shuffled_order(rows: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """``rows`` with ``rank``, the place of their key's hash under seed + epoch."""
    return rows.withColumn("rank", F.xxhash64(F.lit(seed + epoch), key)).orderBy("rank", key)


def shard_offsets(counts: DataFrame) -> DataFrame:
    """(shard, n, first_index): running sums of shard sizes, a table of one row a shard."""
    sums = ordered.running_sums(counts.select("shard", "n"), {"end": "n"}, ("shard",))
    return sums.select("shard", "n", (F.col("end") - F.col("n")).cast("bigint").alias("first_index"))


def assign_batches(rows: DataFrame, size: int, order: tuple[str, ...], range_rows: int = ordered.RANGE_ROWS) -> DataFrame:
    """``rows`` plus ``batch_id`` and ``slot``: runs of ``size`` rows in total order, the last one short.

    Rows are numbered in ranges of the order, as many as their number asks for, so no task sorts all rows.
    """
    place = ordered.numbered(rows, order, name="__place", range_rows=range_rows)
    return place.withColumns({"batch_id": F.floor(F.col("__place") / size), "slot": F.col("__place") % size}).drop("__place")


PRIME, FEISTEL_ROUNDS = (1 << 31) - 1, 4
#: Walks of a cycle at most: places outside are fewer than a side of the square, and a walk goes on outside with a chance of one over that side.
MOST_WALKS = 64


def _round_keys(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """Three numbers below ``PRIME`` for each round."""
    z, out = (seed * 0x9E3779B97F4A7C15 + epoch * 0xD1B54A32D192ED03) % (1 << 64), []
    for _ in range(3 * FEISTEL_ROUNDS):
        z = (z + 0x9E3779B97F4A7C15) % (1 << 64)
        x = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
        out.append((x ^ (x >> 31)) % (PRIME - 1) + 1)
    return list(zip(out[::3], out[1::3], out[2::3], strict=True))


def _sides(n: int) -> tuple[int, int]:
    """Two sides of the smallest near-square that holds ``n`` places."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(index: int, n: int, seed: int, epoch: int) -> int:
    """What :func:`epoch_place` gives, for one row."""
    a, b = _sides(n)
    for _ in range(MOST_WALKS):
        left, right = index // b, index % b
        for k, (x, y, z) in enumerate(_round_keys(seed, epoch)):
            t = ((right if k % 2 == 0 else left) + x) % PRIME
            t = (t * t % PRIME * y + z) % PRIME
            t = t * t % PRIME
            if k % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        index = left * b + right
        if index < n:
            break
    return index


def epoch_place(index: Column, n: int, seed: int, epoch: int) -> Column:
    """The place, 0 to ``n`` - 1, of row ``index`` of ``n`` in an epoch: another permutation for each seed and epoch, without a shuffle.

    A keyed network on a near-square of at least ``n`` places adds to one coordinate a mixing of the other, in turn, which can be undone; a place
    of ``n`` or more is permuted again until it is below, so that no two rows share one.  An index that is not below ``n`` has no place.
    """
    if n > 1 << 60:
        raise ValueError("an epoch has 2 ** 60 rows at most")
    a, b = _sides(n)
    whole = lambda x: F.lit(x).cast("bigint")

    def step(at: Column) -> Column:
        pair = F.struct(F.call_function("div", at, whole(b)).alias("l"), F.pmod(at, whole(b)).alias("r"))
        keys = F.array(*(F.struct(whole(k % 2).alias("k"), whole(x).alias("x"), whole(y).alias("y"), whole(z).alias("z")) for k, (x, y, z) in enumerate(_round_keys(seed, epoch))))

        def mix(p: Column, q: Column) -> Column:
            t = F.pmod(F.when(q["k"] == 0, p["r"]).otherwise(p["l"]) + q["x"], whole(PRIME))
            t = F.pmod(F.pmod(t * t, whole(PRIME)) * q["y"] + q["z"], whole(PRIME))
            t = F.pmod(t * t, whole(PRIME))
            return F.struct(
                F.when(q["k"] == 0, F.pmod(p["l"] + t, whole(a))).otherwise(p["l"]).alias("l"), F.when(q["k"] == 0, p["r"]).otherwise(F.pmod(p["r"] + t, whole(b))).alias("r")
            )

        return F.aggregate(keys, pair, mix, lambda p: p["l"] * whole(b) + p["r"])

    first = step(index.cast("bigint"))
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(MOST_WALKS)), first, lambda at, _: F.when(at < n, at).otherwise(step(at)))
    # nearly every row needs one step
    return F.when((index >= 0) & (index < n), F.when(first < n, first).otherwise(walked))


def mini_batches(rows: DataFrame, index: str, n: int, size: int, seed: int, epoch: int) -> DataFrame:
    """``rows``, whose ``index`` is dense from 0 to ``n`` - 1, plus ``batch_id`` and ``slot`` in an epoch's permutation; the last batch is short."""
    place = epoch_place(F.col(index), n, seed, epoch)
    return rows.withColumn("__place", place).withColumns({"batch_id": F.expr(f"__place div {size}"), "slot": F.expr(f"__place % {size}")}).drop("__place")


def epoch_rows(rows: DataFrame, epochs: int) -> DataFrame:
    """Every row once for each epoch."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def views(rows: DataFrame, n: int) -> DataFrame:
    """Every row once for each of ``n`` views."""
    return rows.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


@contextmanager
def wrapping_arithmetic(spark: SparkSession):
    """Within it, expressions are built whose 64-bit arithmetic wraps around."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def signed(x: int) -> int:
    """``x``, below 2 ** 64, as a signed 64-bit number."""
    return x - (1 << 64) if x >= 1 << 63 else x


def mixed(z: Column) -> Column:
    """One step of the splitmix64 generator from state ``z``; build it within :func:`wrapping_arithmetic`."""
    z = z + F.lit(signed(0x9E3779B97F4A7C15))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * F.lit(signed(0xBF58476D1CE4E5B9))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * F.lit(signed(0x94D049BB133111EB))
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def unsigned_remainder(z: Column, m: Column) -> Column:
    """Remainder of ``z``, read as unsigned, by a small positive ``m``."""
    rest = F.pmod(F.lit(2**62), m)
    rest = F.pmod(rest + rest, m)
    rest = F.pmod(rest + rest, m)
    return F.pmod(F.pmod(z, m) + F.when(z < 0, rest).otherwise(F.lit(0)), m)


#: Fixed value: what an index is multiplied by in a crop's seed.
INDEX_MULTIPLIER = 0xD6E8FEB86659FD93


def unsigned_order(z: Column) -> tuple[Column, Column]:
    """What to order by for the order of ``z`` read as unsigned."""
    return z < 0, z


def crop_start_of(seed: int, index: int, max_start: int) -> int:
    """What :func:`crop_start` gives, for one row."""
    full = (1 << 64) - 1
    z = ((seed ^ (index * INDEX_MULTIPLIER)) + 0x9E3779B97F4A7C15) & full
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
    return (z ^ (z >> 31)) % (max_start + 1)


def crop_start(seed: Column, index: Column, max_start: Column) -> Column:
    """Start of a row's random crop, 0 to ``max_start``; build it within :func:`wrapping_arithmetic`."""
    return unsigned_remainder(mixed(seed.bitwiseXOR(index * F.lit(signed(INDEX_MULTIPLIER)))), max_start + 1)
