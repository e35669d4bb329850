import contextlib
import io

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from tarnwick.functions import augment as G
from tarnwick.plans.queries import QUERIES


def test_each_augmentation_is_called_once(spark):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        QUERIES["augment_sizes"](spark, str(DATA)).explain()
    assert said.getvalue().count("ArrowEvalPython") == 1


def test_augmented_rows_of_any_batch(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("v")).limit(40)
    steps = [G.noise(), G.flip(), G.time_mask(3)]
    got = e.select("vec_id", "v", G.augmented(steps, 8, 8)("v", F.col("vec_id") + 3).alias("out")).collect()
    assert {r.vec_id % 5 for r in got} == set(range(5))
    for r in got:
        want = None if r.v is None else G.apply_steps(np.asarray(r.v, float).reshape(8, 8), steps, r.vec_id + 3).astype(np.float32).ravel().tolist()
        assert r.out == want
