"""Running totals, row numbers and trailing frames in ranges, against one task's answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import evaluation as E
from tarnwick.operators import ordered
from tarnwick.operators import sampling as S
from tarnwick.operators import timeseries as T


def table(spark, n=700, seed=0):
    r = np.random.default_rng(seed)
    rows = [(None if k % 5 == 4 else "ab"[k % 3 == 0], int(r.integers(0, 40)), k, None if k % 11 == 0 else float(r.normal())) for k in range(n)]
    return spark.createDataFrame(rows, "run string, step int, id int, x double"), pd.DataFrame(rows, columns=["run", "step", "id", "x"])


@pytest.mark.parametrize("range_rows, most", [(50, 1 << 16), (30, 4), (10_000, 4)])
def test_running_sums_and_numbers(spark, range_rows, most):
    rows, p = table(spark)
    got = ordered.running_sums(rows, {"s": "x", "n": F.lit(1)}, ("step", F.desc("id")), ("run",), range_rows, most).toPandas().set_index("id")
    p = p.sort_values(["step", "id"], ascending=[True, False])
    want = p.assign(s=p.x.fillna(0).groupby(p.run, dropna=False).cumsum(), n=1 + p.groupby("run", dropna=False).cumcount()).set_index("id")
    assert len(got) == len(want) and np.allclose(got.s.sort_index(), want.s.sort_index()) and (got.n.sort_index() == want.n.sort_index()).all()
    whole = ordered.running_sums(rows, {"n": F.lit(1)}, ("step", "id"), (), range_rows, most).toPandas()
    assert sorted(whole.n) == list(range(1, 701)) and list(whole.sort_values("n").step) == sorted(p.step)


def test_ties_are_cut_between_ranges(spark):
    rows = spark.range(1000).select("id", F.lit(1).alias("same"))
    parts, n = ordered.ranged(rows, ("same",), range_rows=100)
    assert n == 10 and parts.groupBy(ordered.RANGE).count().agg(F.max("count")).first()[0] < 300
    one, two = (ordered.numbered(r, ("same",), range_rows=90).toPandas().set_index("id")[ordered.AT].sort_index() for r in (rows, rows.repartition(7)))
    assert sorted(one) == list(range(1000)) and one.equals(two)


def test_nothing_in_order(spark):
    rows = spark.createDataFrame([], "run string, step int, ts double, loss double")
    assert ordered.running_sums(rows, {"s": "loss"}, ("step",), ("run",)).count() == 0
    assert T.ema(rows, 0.5).count() == T.rolling_std(rows, 3).count() == T.rolling_quantiles(rows, 3, 0.1, 0.9).count() == 0


def test_five_million_rows_of_one_class(spark):
    """No range, and so no task, has more than two ranges' rows."""
    n = 5_000_000
    rows = spark.range(n).select(F.lit(0).alias("class_id"), (F.xxhash64("id") % 1_000_000_007).cast("double").alias("score"), (F.col("id") % 3 == 0).alias("truth"))
    at = rows.groupBy("class_id", "score").agg(F.count("*").alias("n"))
    parts, ranges = ordered.ranged(at, (F.desc("score"),), ("class_id",))
    sizes = parts.groupBy(ordered.RANGE).count().toPandas()["count"]
    assert ranges == -(-sizes.sum() // ordered.RANGE_ROWS) and len(sizes) == ranges and sizes.max() <= 2 * ordered.RANGE_ROWS
    got = E.average_precision(rows).first()
    assert got["n_positive"] == -(-n // 3) and got["ap"] == pytest.approx(1 / 3, abs=2e-3)


@pytest.mark.parametrize("block", [25, 64, 10_000])
def test_frames_across_blocks(spark, block):
    r = np.random.default_rng(3)
    rows = [("ab"[k % 4 == 0], k // 2, float(k), None if k % 13 == 5 else float(r.normal())) for k in range(600)]
    frame = spark.createDataFrame(rows, "run string, step int, ts double, loss double")
    p = pd.DataFrame(rows, columns=["run", "step", "ts", "loss"])
    std, band = T.rolling_std(frame, 20, block=block).toPandas(), T.rolling_quantiles(frame, 20, 0.1, 0.9, block=block).toPandas()
    assert len(std) == len(band) == 600
    for run, of in p.groupby("run"):
        for c, got in (("std", std), ("low", band), ("high", band)):
            want = [np.array([x for x in of.loss.iloc[max(0, k - 19) : k + 1] if x == x]) for k in range(len(of))]
            want = [np.nan if not len(w) else w.std() if c == "std" else np.quantile(w, 0.1 if c == "low" else 0.9) for w in want]
            assert np.allclose(got[got.run == run].sort_values("ts")[c].to_numpy(float), want, equal_nan=True)


def test_one_long_run_is_spread(spark):
    """A run of five million rows: blocks of bounded size, smoothed alike."""
    n = 5_000_000
    rows = spark.range(n).select(F.lit("a").alias("run"), F.col("id").alias("step"), F.lit(0.0).alias("ts"), (F.col("id") % 10).cast("double").alias("loss"))
    parts = ordered.blocks(rows, ("step",), ("run",), T.BLOCK, 49)
    sizes = parts.groupBy(ordered.BLOCK).count().toPandas()["count"]
    assert len(sizes) == -(-n // T.BLOCK) and sizes.max() == T.BLOCK + 49
    out = T.ema(rows, 0.1)
    level = 9.0
    last = {r["step"]: r["ema"] for r in out.where(f"step >= {n - 3}").collect()}
    e = 0.0
    for k in range(400):
        e = 0.1 * ((n - 400 + k) % 10) + 0.9 * e
    assert last[n - 1] == pytest.approx(e, abs=1e-9) and 0 < e < level
    std = T.rolling_std(rows, 50).where("step >= 49").agg(F.min("std"), F.max("std"), F.count("*")).first()
    assert std[0] == pytest.approx(8.25**0.5) and std[1] == pytest.approx(8.25**0.5) and std[2] == n - 49


def test_batches_in_many_ranges(spark):
    rows = spark.range(1003).select("id", (F.col("id") * 37 % 11).alias("k"))
    got = S.assign_batches(rows, 10, ("k", "id"), range_rows=100).collect()
    order = [r["id"] for r in sorted(got, key=lambda r: (r["batch_id"], r["slot"]))]
    assert order == sorted(range(1003), key=lambda i: (i * 37 % 11, i))


def test_smoothing_of_many_short_runs_makes_no_group_each(spark):
    from tarnwick.operators import timeseries as T

    rows = spark.range(4000).selectExpr("id div 4 AS run", "id % 4 AS step", "id AS ts", "cast(id % 7 AS double) AS loss")
    out = T.ema(rows, 0.25, block=2)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got, now = {(r["run"], r["step"]): r["ema"] for r in out.collect()}, 0.0
    for k in range(4000):
        now = k % 7 if k % 4 == 0 else 0.25 * (k % 7) + 0.75 * now
        assert abs(got[k // 4, k % 4] - now) < 1e-12
