"""Probes: gradients against differences, steps and epochs against a twin in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import evaluation as E
from tarnwick.operators import probes as P
from tarnwick.operators.sampling import permuted


def test_loss_is_the_columns_one(spark):
    z = np.concatenate([np.linspace(-30, 30, 41), [0.1, -3.0]])
    for y in (0, 1):
        got = spark.createDataFrame([(float(x),) for x in z], "z double").select(E.asymmetric_loss(E.sigmoid(F.col("z")), F.lit(y)).alias("l")).toPandas()["l"]
        assert np.allclose(P.loss_and_slope(z, np.full(len(z), y))[0], got, atol=1e-9)


@pytest.mark.parametrize("make", [P.linear_probe, P.mlp_probe])
def test_gradient_by_differences(make):
    r = np.random.default_rng(0)
    w = {k: x + r.normal(size=x.shape) * 0.3 for k, x in make(5, 3, 1).items()}
    x, y = r.normal(size=(7, 5)), (r.random((7, 3)) < 0.4).astype(float)
    g, total = P.gradient(w, x, y), lambda v: P.loss_and_slope(P.forward(v, x)[0], y)[0].sum()
    for k in w:
        for at in list(np.ndindex(w[k].shape))[:6]:
            up, down = (w | {k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[k][at] == pytest.approx((total(up) - total(down)) / 2e-6, abs=1e-5)


def test_a_step_by_hand():
    w = {"w": np.array([[1.0, -2.0]]), "b": np.array([0.5])}
    adam = P.Adam(w, rate=0.1, decay=0.01, clip=1.0)
    adam.step({"w": np.array([[3.0, 0.0]]), "b": np.array([4.0])})  # norm 5, cut to 1: 0.6, 0, 0.8
    assert np.allclose(adam.w["w"], [[1 - 0.1 * (1 + 0.01), -2 - 0.1 * (0 + 0.01 * -2)]], atol=1e-6) and np.allclose(adam.w["b"], [0.5 - 0.1 * (1 + 0.005)], atol=1e-6)
    adam.step({"w": np.array([[0.0, 0.3]]), "b": np.array([0.0])})  # below the clip
    m, s = 0.1 * 0.3 / (1 - 0.9**2), 0.05 * 0.09 / (1 - 0.95**2)
    assert adam.w["w"][0, 1] == pytest.approx(-1.998 - 0.1 * (m / (np.sqrt(s) + 1e-8) + 0.01 * -1.998), abs=1e-6)


@pytest.mark.parametrize("make, several", [(P.linear_probe, False), (P.mlp_probe, True)])
def test_epochs_equal_a_twin(spark, make, several):
    r = np.random.default_rng(3)
    n, size, classes, batch = 53, 4, 3, 16
    x = r.normal(size=(n, size))
    y = [sorted(set(r.integers(0, classes, 2).tolist())) if several else int(r.integers(0, classes)) for _ in range(n)]
    kind = "array<int>" if several else "int"
    rows = spark.createDataFrame([(100 - i, x[i].tolist(), y[i], "z") for i in range(n)] + [(500, None, y[0], "z"), (501, x[0].tolist(), None, "z")], f"id bigint, embedding array<double>, label {kind}, batch_id string")
    got = P.fit(rows.repartition(3), make(size, classes, 1), "id", epochs=2, batch=batch, seed=7)
    adam = P.Adam(make(size, classes, 1))
    hot = np.zeros((n, classes))
    for i in range(n):
        hot[i, y[i]] = 1
    order = np.argsort([100 - i for i in range(n)])
    for epoch in range(2):
        place = np.array([permuted(k, n, 7, epoch) for k in range(n)])
        for k in range(-(-n // batch)):
            of = order[place // batch == k]
            adam.step({c: g / (len(of) * classes) for c, g in P.gradient(adam.w, x[of], hot[of]).items()})
    assert all(np.allclose(got[k], adam.w[k], atol=1e-10) for k in got) and not np.allclose(got["w"], make(size, classes, 1)["w"])
    assert P.fit(rows.limit(0), make(size, classes, 1), "id")["b"].tolist() == [0] * classes


def test_scores_of_rows(spark):
    w = P.linear_probe(4, 2, 0)
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None)], "id int, embedding array<double>")
    got = P.scores(rows, w).orderBy("class_id").collect()
    assert [r["score"] for r in got] == pytest.approx(P.forward(w, np.array([[1.0, 2, 3, 4]]))[0][0].tolist()) and {r["id"] for r in got} == {1}
