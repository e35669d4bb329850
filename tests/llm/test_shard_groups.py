"""Histogram sort: splitters against sorting all keys, and groups of equal texts."""

import zlib

import numpy as np
import pytest

from tarnwick.llm import queries, sharding


def prose(r, n):
    return " ".join("".join(r.choice(["ka", "mi", "to", "re"], r.integers(1, 4))) for _ in range(n))


@pytest.mark.parametrize("subranges", [1, 3])
def test_groups_of_five_stay_together(spark, subranges):
    r = np.random.default_rng(0)
    texts = [prose(r, int(r.integers(5, 60))) for _ in range(240)]
    rows = [(5 * i + k, t) for i, t in enumerate(texts) for k in range(5)]
    out = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id bigint, text string"), subranges=subranges).toPandas()
    assert len(out) == 1200 and out.groupby("text").shard.nunique().max() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    size = (out.text.str.len() + 8).groupby(out.shard).sum()
    most = max(5 * (len(t) + 8) for t in texts)
    assert len(size) == 24 and (abs(size - size.sum() / 24) <= most).all()


def test_only_a_group_larger_than_a_shard_is_split(spark):
    r = np.random.default_rng(1)
    hot, rest = prose(r, 40), [prose(r, 40) for _ in range(300)]
    rows = [(i, hot if i % 3 == 0 else rest[i % 300]) for i in range(3000)]
    out = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=6, subranges=2, tolerance=0.001).toPandas()
    shards = out.groupby("text").shard.nunique()
    assert shards[hot] in (2, 3) and shards.drop(hot).max() == 1
    size = (out.text.str.len() + 8).groupby(out.shard).sum()
    assert size.max() - size.min() < 0.2 * size.mean()


def test_splitters_as_by_sorting(spark):
    r = np.random.default_rng(2)
    keys = sorted((f"{int(r.integers(0, 1 << 48)):012x}{int(r.integers(0, 1 << 62)):016x}", int(r.integers(1, 500))) for _ in range(3000))
    frame = spark.createDataFrame(keys, "key string, size bigint").repartition(5)
    total = sum(s for _, s in keys)
    found = sharding.find_splitters(frame, 10, 0.0)
    ends = np.concatenate([[0], np.cumsum([s for _, s in keys])])
    for k, f in enumerate(found):
        below = [s for x, s in keys if x < f.key]
        assert f.size == sum(below) and f.rows == len(below)
        assert abs(f.size - total * (k + 1) / 10) == min(abs(ends - total * (k + 1) / 10))  # every text is a group of its own here


def test_digests_of_texts(spark, tmp_path):
    texts = ["a", None, "", "é\n😀", "a"]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, shard int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_sharding(spark, f"file://{tmp_path}").toPandas().set_index("doc_id")
    assert [out.text_crc32[i] for i in range(5)] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [out["size"][i] for i in range(5)] == [len((t or "").encode()) + 8 for t in texts] and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
