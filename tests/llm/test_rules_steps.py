"""Quality rules on counted vectors: as on single ones, and a warning where steps have not settled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import rules


def test_counted_vectors_and_unsettled_steps(spark):
    r = np.random.default_rng(0)
    rows = [("g", *map(int, np.rint(r.normal(size=4) * [30, 4, 4, 8] + [200, 0, 0, 20]))) for _ in range(400)]
    single = spark.createDataFrame(rows * 2, "grp string, x1 bigint, x2 bigint, x3 bigint, x4 bigint")
    counted = single.groupBy("grp", *rules.STATS).agg(F.count("*").alias("times"))
    wide = [F.lit(900.0 if i == j else 0.0).alias(f"r{i}{j}") for i, j in rules._pairs()]
    found = []
    for table in (single, counted):
        middle = rules.medians(table)
        prior = middle.select("grp", *(F.col(f"med{i}").alias(f"q{i}") for i in range(4)), *wide)
        found.append(rules.estimate(table, middle, prior).first())
    assert found[0] == found[1]
    with pytest.warns(RuntimeWarning, match="still change"):
        rules.estimate(counted, middle, prior, most_steps=1)
