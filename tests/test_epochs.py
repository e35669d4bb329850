"""Permutations of epochs by a keyed network."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import sampling as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 13, 64, 101, 997, 4099])
def test_every_place_once(n):
    places = [S.permuted(i, n, 5, 1) for i in range(n)]
    assert sorted(places) == list(range(n))
    if n > 60:
        assert places != [S.permuted(i, n, 5, 2) for i in range(n)] and places != [S.permuted(i, n, 6, 1) for i in range(n)]
        assert abs(np.corrcoef(places, range(n))[0, 1]) < 0.3


@pytest.mark.parametrize("n", [1, 7, 1009])
def test_column_and_batches(spark, n):
    rows = spark.range(n).repartition(3)
    got = rows.select("id", S.epoch_place(F.col("id"), n, 5, 1).alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == {i: S.permuted(i, n, 5, 1) for i in range(n)}
    out = S.mini_batches(rows, "id", n, 10, 5, 1).toPandas()
    assert sorted(out.batch_id * 10 + out.slot) == list(range(n)) and out.slot.max() < 10
    plan = S.mini_batches(spark.range(n), "id", n, 10, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_rows_beyond_the_epoch_have_no_place(spark):
    got = [r["p"] for r in spark.createDataFrame([(-1,), (0,), (5,), (None,)], "i bigint").select(S.epoch_place(F.col("i"), 5, 1, 1).alias("p")).collect()]
    assert got[0] is None and got[1] is not None and got[2] is None and got[3] is None


def test_a_large_epoch(spark):
    n = (1 << 45) + 12_345
    got = spark.range(1000).select((F.col("id") * 33_333_333_331).alias("i")).select("i", S.epoch_place(F.col("i"), n, 3, 0).alias("p")).collect()
    assert all(r["p"] == S.permuted(r["i"], n, 3, 0) for r in got if r["i"] < n) and len({r["p"] for r in got}) == 1000
