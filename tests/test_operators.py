import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.operators import diagnostics as D
from tarnwick.operators import evaluation as E
from tarnwick.operators import relational as R
from tarnwick.operators import sampling as S
from tarnwick.operators import timeseries as T


def batches(spark, lists):
    return spark.createDataFrame([(s, i) for s, x in enumerate(lists) for i in x], "step bigint, index bigint")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=6), min_size=1, max_size=9), st.integers(1, 4))
def test_sliding_distinct(spark, lists, window):
    got = {r["step"]: r["n_unique"] for r in D.sliding_distinct(batches(spark, lists), window).collect()}
    assert got == {s: len(set().union(*lists[max(0, s - window + 1) : s + 1])) for s in range(len(lists))}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 7), min_size=1, max_size=9), min_size=1, max_size=6))
def test_overlap_chi_square_and_correlation(spark, lists):
    n = 4
    hist = D.histogram(batches(spark, lists), D.bucket(F.col("index"), n, "mod", 8))
    h = np.array([np.bincount(np.array(x) % n, minlength=n) for x in lists], float)
    chi = {r["step"]: r["chi2"] for r in D.chi_square(hist, n).collect()}
    acf = {r["step"]: r["acf"] for r in D.lag1_correlation(hist, n).collect()}
    common = {r["step"]: r["overlap"] for r in D.overlap(hist).collect()}
    for s, x in enumerate(h):
        e = x.sum() / n
        assert chi[s] == pytest.approx(((x - e) ** 2 / e).sum(), abs=1e-9)
        before = h[s - 1] if s else None
        assert common[s] == (np.minimum(x, before).sum() if s else 0)
        flat = before is None or x.std() * before.std() < 1e-10
        assert acf[s] == pytest.approx(1.0 if flat else np.corrcoef(x, before)[0, 1], abs=1e-6)


def test_bucket_rules(spark):
    df = spark.range(0, 40).select(*(D.bucket(F.col("id"), 6, m, 40).alias(m) for m in D.METHODS), "id")
    for r in df.collect():
        assert (r["mod"], r["div"], r["hash"]) == (r["id"] % 6, min(r["id"] // 6, 5), r["id"] * D.MULTIPLIER % 6)
    with pytest.raises(ValueError):
        D.bucket(F.lit(1), 2, "other", 3)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ema_in_blocks(spark, block):
    v = np.random.default_rng(0).normal(size=25)
    rows = spark.createDataFrame([("a", i, float(i), float(x)) for i, x in enumerate(v)], "run string, step bigint, ts double, loss double")
    got = [r["ema"] for r in T.ema(rows, 0.3, block=block).orderBy("step").collect()]
    want = [v[0]]
    for x in v[1:]:
        want.append(0.3 * x + 0.7 * want[-1])
    assert got == pytest.approx(want)


def test_segments_and_transitions(spark):
    rows = spark.createDataFrame([("a", s, float(t), float(s)) for t, s in enumerate([1, 2, 5, 3, 4, 2])], "run string, step bigint, ts double, loss double")
    seg = [r["segment"] for r in T.segments(rows).orderBy("ts").collect()]
    assert seg == [0, 0, 0, 1, 1, 2]
    assert [r["step"] for r in T.resume_steps(T.segments(rows)).orderBy("segment").collect()] == [3, 2]
    assert T.transitions(rows, 600).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.booleans()), min_size=1, max_size=15))
def test_average_precision_with_ties(spark, items):
    rows = spark.createDataFrame([(0, float(s), t) for s, t in items], "class_id int, score double, truth boolean")
    got = E.average_precision(rows).collect()
    positives = sum(t for _, t in items)
    if not positives:
        assert got == []
        return
    ap, last = 0.0, 0.0
    for level in sorted({s for s, _ in items}, reverse=True):
        above = [t for s, t in items if s >= level]
        ap += (sum(above) / positives - last) * sum(above) / len(above)
        last = sum(above) / positives
    assert got[0]["ap"] == pytest.approx(ap)


def test_centroids_with_missing_class(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0])], "label int, embedding array<float>")
    classes = spark.createDataFrame([(0,), (1,)], "class_id int")
    got = {r["class_id"]: r["centroid"] for r in E.centroids(rows, 2, classes=classes).collect()}
    assert got == {0: [2.0, 3.0], 1: [0.0, 0.0]}


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("label"))
    one, many = (sorted(r["id"] for r in S.stratified_sample(rows.repartition(n), 5, 1).collect()) for n in (1, 9))
    assert one == many and len(one) == 35
    assert S.uniform_sample(rows, 1000, 1).count() == 500


def test_batches_are_a_permutation(spark):
    rows = spark.range(103).select("id", (F.col("id") * 37 % 11).alias("k"))
    got = S.assign_batches(rows, 10, ("k", "id")).collect()
    order = [r["id"] for r in sorted(got, key=lambda r: (r["batch_id"], r["slot"]))]
    assert order == sorted(range(103), key=lambda i: (i * 37 % 11, i))


def test_relaxed_union_and_flatten(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, 3)], "k double, n bigint")
    got = R.relaxed_union(a, b, spark.createDataFrame([("t",)], "k string"))
    assert dict(got.dtypes) == {"k": "string", "s": "string", "n": "bigint"} and got.count() == 3
    nested = spark.createDataFrame([((1, (2,)), [3])], "a struct<b: int, c: struct<d: int>>, e array<int>")
    assert R.flatten(nested, drop=("a.b",)).first().asDict() == {"a.c.d": 2, "e": "[3]"}
    assert R.drop_matching(nested, "^a.*$").columns == ["e"]
    assert R.numeric_only(nested).columns == ["e"]
    assert R.measured_columns(a, ("k", "s")) == ["k", "s"]


def test_losses(spark):
    row = spark.range(1).select(E.asymmetric_loss(F.lit(0.02), F.lit(0)).alias("a"), E.cross_entropy(F.array(F.lit(1.0), F.lit(2.0)), F.lit(1)).alias("c"), E.arg_max(F.array(F.lit(1), F.lit(5), F.lit(5))).alias("m")).first()
    assert row["a"] == pytest.approx(0.0) and row["c"] == pytest.approx(np.log(1 + np.exp(-1))) and row["m"] == 1


def test_schedules(spark):
    got = [r[0] for r in spark.range(6).select(T.wsd_rate(F.col("id") * 2, 1.0, 4, 2, 4)).collect()]
    assert got == pytest.approx([0, 0.5, 1, 1, 0.5, 0])


def test_linear_probe_and_registry(spark):
    from tarnwick.operators import backbones as B

    r = np.random.default_rng(0)
    x = r.normal(size=(200, 6))
    rows = spark.createDataFrame([(v.tolist(), int(v[:3].argmax())) for v in x], "embedding array<double>, label int")
    got = B.linear_scores(rows, B.fit_linear(rows, 6, 3, rounds=25)).groupBy("embedding", "label").agg(F.max_by("class_id", "score").alias("c"))
    assert got.where("c = label").count() > 180
    assert B.names() == ["identity", "patch_mean"]
    with pytest.raises(KeyError):
        B.loader("none")
    with pytest.warns(UserWarning):
        B.register("identity", B.loader("identity"))
    assert len(rows.select(B.encoded("patch_mean", "a", "embedding")).first()[0]) == 32


def test_batches_without_a_reused_exchange(spark):
    from tarnwick.operators.sampling import assign_batches

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(1_000_000).select("id", F.xxhash64("id").alias("h"))
        sizes = assign_batches(rows, 64, ("h", "id")).groupBy("batch_id").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert [(r["count"], r["n"]) for r in sizes] == [(64, 15625)]


def test_report_of_missing_cells(spark):
    from tarnwick.operators.relational import report

    rows = spark.createDataFrame([("a", "m", "linear", -1, 0.5, 1), ("b", "m", "linear", 5, 0.25, 2), ("b", "m", "linear", 5, 0.75, 3)], "task_name string, model_ckpt string, clf string, n_train int, cmap double, file_name int")
    got = {r["n_train"]: (r["a"], r["b"]) for r in report(rows, ["a", "b"]).collect()}
    assert got == {"all": ("50.00", "-"), "5": ("-", "75.00")}


def test_lines_with_nulls_in_lists(spark):
    from tarnwick.operators.sinks import csv_lines

    rows = spark.createDataFrame([(1, 0.5, [1.0, None, 2.5]), (2, None, None)], "a int, b double, c array<double>")
    assert sorted(r["line"] for r in csv_lines(rows).collect()) == ["1,0.5,1||2.5", "2,,"]


def test_checks_of_a_checkpoint(spark, tmp_path):
    from tarnwick.operators.sinks import load_checkpoint, log_metrics, save_checkpoint
    from tarnwick.sources.logs import history

    path = f"file://{tmp_path}/saved"
    state = spark.createDataFrame([("w", [3.0, 4.0]), ("b", [1.0])], "component string, values array<double>")
    assert save_checkpoint(state, path, 5, config={"a": 1}) and not save_checkpoint(state, path, 5, config={"a": 1})
    assert load_checkpoint(spark, path, {"a": 1}).count() == 2
    with pytest.raises(ValueError):
        load_checkpoint(spark, path, {"a": 2})
    spark.createDataFrame([("w", [3.0, 5.0]), ("b", [1.0])], "component string, values array<double>").write.mode("overwrite").parquet(f"{path}/step=5")
    with pytest.raises(ValueError):
        load_checkpoint(spark, path, {"a": 1})
    log = f"file://{tmp_path}/log"
    for step in (1, 2):
        log_metrics(spark.createDataFrame([("r", step, 0.5 / step)], "run_id string, step bigint, loss double"), log)
    assert sorted((r["step"], r["loss"]) for r in history(spark, log).collect()) == [(1, 0.5), (2, 0.25)]
    spark.createDataFrame([("r", 3, (0.125,))], "run_id string, step bigint, summary struct<loss:double>").write.json(f"file://{tmp_path}/other")
    assert [(r["step"], r["loss"]) for r in history(spark, f"file://{tmp_path}/other").collect()] == [(3, 0.125)]


def test_mlp_probe_learns_what_is_not_linear(spark):
    from tarnwick.operators import backbones as B

    r = np.random.default_rng(2)
    x = r.standard_normal((600, 4))
    rows = spark.createDataFrame([(v.tolist(), int(v[0] * v[1] > 0)) for v in x], "embedding array<double>, label int")
    weights = B.fit_mlp(rows, 4, 2, hidden=24, rounds=80, rate=0.05)
    scored = B.mlp_scores(rows, weights).where("class_id = 1").select(((F.col("score") > 0).cast("int") == F.col("label")).cast("int").alias("ok"))
    assert scored.agg(F.avg("ok")).first()[0] > 0.7
