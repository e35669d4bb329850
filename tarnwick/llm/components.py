"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, materialise


def _least(edges: DataFrame) -> DataFrame:
    """For each node ``u`` the least of itself and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (u, v); component: the least node reachable.

    Every round is a few joins and partial aggregations, so that a node with very many edges is
    split like any skewed join key.  Edges with a null end and loops are ignored.  It ends when a
    round changes nothing, after a number of rounds that grows with the logarithm of the size.
    """
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "edges")
        small = large.join(_least(large), "u")  # every edge points down already
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_least(large).withColumnRenamed("m", "v"))
        old, now = now, materialise(small.where("u <> v").distinct(), "edges")
        forget(old)
        forget(large)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
