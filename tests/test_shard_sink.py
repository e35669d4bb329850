"""Shards that Spark wrote, read back: order, folders, sizes, nulls, tasks that fail."""

import pytest
from pyspark.sql import functions as F

from tarnwick.sources import shards
from tarnwick.sources.shard_sink import write_shards
from tarnwick.sources.shards import read_shards


def rows(spark, n=100, tasks=3):
    r = spark.range(0, n, 1, tasks).withColumn("split", F.when(F.col("id") % 10 == 0, "test").when(F.col("id") % 10 < 9, "train"))
    audio = F.when(F.col("id") % 7 > 0, F.struct(F.when(F.col("id") % 7 > 1, F.encode(F.col("id").cast("string"), "utf-8")).alias("bytes"), F.lit("p").alias("path")))
    return r.withColumns({"audio": audio, "label": F.when(F.col("id") != 5, F.col("id"))})


def test_order_sizes_and_folders(spark, tmp_path):
    uri = f"file://{tmp_path}/s"
    write_shards(rows(spark), uri, shard_rows=8)
    back = read_shards(spark, uri)
    assert back.count() == 100 and back.groupBy("path").count().agg(F.max("count")).first()[0] == 8
    train = [r["label"] for r in read_shards(spark, uri, split="train").orderBy("index").collect()]
    assert train == [i if i != 5 else None for i in range(100) if 0 < i % 10 < 9]
    assert back.where("split is null").count() == 10
    got = {r["label"]: r["audio"] and r["audio"]["bytes"] and bytes(r["audio"]["bytes"]).decode() for r in back.where("label is not null").collect()}
    assert got == {i: str(i) if i % 7 > 1 else None for i in range(100) if i != 5}
    assert not [p for p in tmp_path.rglob("_*")]


def test_append_and_overwrite(spark, tmp_path):
    uri = f"file://{tmp_path}/s"
    for n, mode, left in ((10, "append", 10), (20, "append", 30), (5, "overwrite", 5)):
        write_shards(rows(spark, n), uri, mode=mode)
        assert read_shards(spark, uri).count() == left
    write_shards(rows(spark, 0), uri)
    assert read_shards(spark, uri).count() == 5


def test_a_failed_write_leaves_no_shard(spark, tmp_path):
    uri = f"file://{tmp_path}/s"
    write_shards(rows(spark, 10), uri)
    broken = rows(spark).withColumn("label", F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error("broken").cast("bigint")))
    with pytest.raises(Exception, match="broken"):
        write_shards(broken, uri, shard_rows=4)
    assert read_shards(spark, uri).count() == 10 and not [p for p in tmp_path.rglob("_*")]


def test_missing_columns(spark, tmp_path):
    with pytest.raises(Exception, match="shards need the columns"):
        rows(spark).drop("audio").select("label").write.format("shards").mode("append").save(f"file://{tmp_path}/s")


def test_many_small_shards_share_tasks(spark, tmp_path):
    rows = spark.range(3000).select(F.struct(F.encode(F.col("id").cast("string"), "utf-8").alias("bytes"), F.lit("a").alias("path")).alias("audio"), F.col("id").alias("label")).repartitionByRange(4, "label").sortWithinPartitions("label")
    uri = f"file://{tmp_path}/s"
    write_shards(rows, uri, shard_rows=10)
    out = shards.read_shards(spark, uri, exclude=(7,))
    assert len(shards.listed(uri)) >= 300 and out.rdd.getNumPartitions() < 40
    got = out.select("index", "label", "position", "shard").orderBy("index").collect()
    assert [r["label"] for r in got] == [r["index"] for r in got] == [k for k in range(3000) if k != 7] and len({r["shard"] for r in got}) == len(shards.listed(uri))
