import io
import json
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import diagnostics, sinks
from tarnwick.operators.loader import load_shards
from tarnwick.sources import logs, shards
from tarnwick.streaming import stateful


def write_shard(path, rows, label=pa.int64()):
    audio = pa.array([{"bytes": b, "path": p} for b, p, _ in rows], pa.struct([("bytes", pa.binary()), ("path", pa.string())]))
    batch = pa.RecordBatch.from_arrays([audio, pa.array([x for *_, x in rows], label)], names=["audio", "label"])
    with pa.ipc.new_stream(path, batch.schema) as out:
        out.write_batch(batch)


def test_shards(spark, tmp_path):
    write_shard(tmp_path / "b.arrow", [(b"3", "c", None)])
    write_shard(tmp_path / "a.arrow", [(b"1", "a", 4), (b"2", "b", 5)])
    got = [(r["index"], r["shard"], bytes(r["audio"]["bytes"]), r["label"]) for r in shards.read_shards(spark, f"file://{tmp_path}").orderBy("index").collect()]
    assert got == [(0, 0, b"1", 4), (1, 0, b"2", 5), (2, 1, b"3", None)]


def test_shard_of_another_type(spark, tmp_path):
    write_shard(tmp_path / "a.arrow", [(b"1", "a", "x")], pa.string())
    with pytest.raises(Exception, match="missing or of another type"):
        shards.read_shards(spark, f"file://{tmp_path}").collect()


def sound(n=400):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.sin(np.arange(n)) * 9000).astype("<i2").tobytes())
    return out.getvalue()


def splits(path):
    for split, shard, ids in (("train", "a", (1, 2)), ("train", "b", (3, 4, 5)), ("test", "a", (6,))):
        (path / f"split={split}").mkdir(exist_ok=True)
        write_shard(path / f"split={split}/{shard}.arrow", [(str(i).encode(), "p", i) for i in ids])


def test_filters_reach_the_shards(spark, tmp_path):
    splits(tmp_path)
    uri = f"file://{tmp_path}"
    rows = shards.read_shards(spark, uri, split="train", exclude=(0, 3))
    assert [(r["index"], r["label"], r["split"]) for r in rows.orderBy("index").collect()] == [(1, 2, "train"), (2, 3, "train"), (4, 5, "train")]
    for wrong in ((-1,), (0, 5)):
        with pytest.raises(ValueError, match="out of range"):
            shards.read_shards(spark, uri, split="train", exclude=wrong)
    some = shards.read_shards(spark, uri, where=(("index", ">=", 1), ("position", "<", 2), ("path", "in", ["split=train/a.arrow", "split=train/b.arrow"])))
    assert [r["index"] for r in some.orderBy("index").collect()] == [1, 2, 3, 4]
    everything = shards.read_shards(spark, uri)
    test, train = (everything.where(f"split = '{x}'").select("index") for x in ("test", "train"))
    assert everything.count() == 6 == test.union(train).distinct().count() == test.union(train).count()


def without_first(path):
    (path / "split=train/a.arrow").write_bytes(b"no stream")


ALIKE = [("shard", "in", [0, 2]), ("split", "=", "test"), ("index", ">", 2), ("index", "not in", [1, 2, 0]), ("index", "=", 4), ("path", "=", "split=train/b.arrow"), ("index", "<=", 0), ("index", "<", 1)]


def test_excluded_shards_are_never_opened(spark, tmp_path):
    splits(tmp_path)
    uri, opened = f"file://{tmp_path}", shards.ShardReader({"path": f"file://{tmp_path}"})
    first = {"split=test/a.arrow": (0, 1), "split=train/a.arrow": (1, 2), "split=train/b.arrow": (3, 3)}
    assert [p.name for p in opened.partitions()] == list(first)
    for where in ALIKE:
        names = [p.name for p in shards.ShardReader({"path": uri, "first": json.dumps(first), "where": json.dumps([where])}).partitions()]
        assert names and "split=train/a.arrow" not in names
    for where, left in ((("index", "=", 1), 1), (("index", ">=", 2), 2), (("index", "not in", [1]), 3), (("position", ">", 1), 1)):
        assert len(shards.ShardReader({"path": uri, "first": json.dumps(first), "where": json.dumps([where])}).partitions()) == left
    without_first(tmp_path)
    assert shards.read_shards(spark, uri, split="test").count() == 1
    with pytest.raises(Exception):
        shards.read_shards(spark, uri)


def test_filters_that_spark_pushes(spark, tmp_path):
    splits(tmp_path)
    without_first(tmp_path)
    spark.dataSource.register(shards.ShardSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("shards").option("push", "true").load(f"file://{tmp_path}")
        for alike, n in (("shard <> 1", 4), ("split = 'test'", 1), ("shard IN (0, 2) AND position > 0", 2), ("path > 'split=train/a.arrow' AND label <> 4", 2), ("NOT split = 'train'", 1)):
            assert load().where(alike).count() == n
        with pytest.raises(Exception):
            load().where("position > 5").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bad_shards_are_rows_and_counted(spark, tmp_path):
    good = sound()
    write_shard(tmp_path / "a.arrow", [(good, "p", 1), (b"broken", "p", 2), (good, "p", 3)])
    write_shard(tmp_path / "b.arrow", [(good, "p", 4)])
    whole = (tmp_path / "b.arrow").read_bytes()
    (tmp_path / "c.arrow").write_bytes(whole[: len(whole) - 300])  # cut off
    (tmp_path / "d.arrow").write_bytes(b"")
    write_shard(tmp_path / "e.arrow", [(good, "p", "x")], pa.string())
    with pytest.raises(Exception):
        shards.read_shards(spark, f"file://{tmp_path}").count()
    rows = shards.read_shards(spark, f"file://{tmp_path}", bad="rows")
    found = rows.where("error is not null").orderBy("path").collect()
    assert [(r["path"], r["position"], r["index"], r["label"]) for r in found] == [(f"{x}.arrow", 0, None, None) for x in "cde"]
    clips, seen = load_shards(spark, f"file://{tmp_path}", rate=8000, seconds=0.2, exclude=(3,))
    out = clips.toPandas()
    assert sorted(out[out.ok].label) == [1, 3] and seen.get == {"good": 2, "bad_rows": 1, "bad_shards": 3}
    assert "broken" in (tmp_path / "a.arrow").read_bytes().decode("latin1") and out[~out.ok].error.notna().all()


def test_stream_of_shards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    uri, rows = f"file://{tmp_path}/in", lambda: sorted(r["label"] for r in spark.read.parquet(f"file://{tmp_path}/out/data").collect())
    write_shard(tmp_path / "in/m.arrow", [(b"1", "a", 1), (b"2", "b", 2)])
    stateful.run_available(shards.stream_shards(spark, uri), f"file://{tmp_path}/out")
    assert rows() == [1, 2]
    write_shard(tmp_path / "in/a.arrow", [(b"3", "a", 3)])  # before the first in order
    write_shard(tmp_path / "in/z.arrow", [(b"4", "a", 4)])
    write_shard(tmp_path / "in/_part.arrow", [(b"5", "a", 5)])
    for _ in range(2):  # started anew from its checkpoint, it reads no shard twice
        stateful.run_available(shards.stream_shards(spark, uri), f"file://{tmp_path}/out")
        assert rows() == [1, 2, 3, 4]


def test_logs_and_history(spark, tmp_path):
    (tmp_path / "x.log").write_text("start\nstep=1 norm=2.5\nnoise\nstep=3 norm=4.0\n")
    got = [(r["step"], r["value"]) for r in logs.log_values(spark, str(tmp_path / "x.log"), r"step=(\d+) norm=([\d.]+)").orderBy("line").collect()]
    assert got == [(1, 2.5), (3, 4.0)]
    assert logs.first_match(spark, str(tmp_path / "x.log"), r"step=(\d+)", last=True) == "3"
    lines = [{"run_id": "a", "_step": 1, "loss": 0.5}, {"run_id": "a", "step": 2}, {"run_id": "a", "loss": 1.0}]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, lines)))
    assert [(r["step"], r["loss"]) for r in logs.history(spark, str(tmp_path / "h.json")).collect()] == [(1, 0.5)]


def test_results(spark, tmp_path):
    path = str(tmp_path / "results")
    assert sinks.read_results(spark, path) is None and not sinks.already_ran(spark, path, {"clf": "mlp"})
    result = spark.createDataFrame([("mlp", 0.5)], "clf string, cmap double")
    pred = spark.createDataFrame([("b", [1], [1], [0.9]), ("a", [0], [], [0.1])], "example_id string, y_true array<int>, y_pred array<int>, y_score array<double>")
    sinks.write_result(result, pred, path)
    sinks.write_result(result.withColumn("clf", F.lit("centroid")), pred, path, most=2)
    rows = {r["clf"]: r for r in sinks.read_results(spark, path).collect()}
    assert rows["mlp"]["pred_example_ids"] == ["a", "b"] and rows["mlp"]["pred_y_true"] == [[0], [1]]
    assert rows["centroid"]["pred_example_ids"] is None
    assert sinks.already_ran(spark, path, {"clf": "mlp"}) and not sinks.already_ran(spark, path, {"clf": "linear"})


def test_csv_and_checkpoints(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.123456789, [1.0, 2.5]), (1, None, None)], "k int, x double, l array<double>")
    assert [r["line"] for r in sinks.csv_lines(rows).collect()] == ["2,0.123457,1|2.5", "1,,"]
    sinks.write_csv(rows.drop("l"), str(tmp_path / "csv"), ("k",))
    assert "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")).split() == ["k,x", "1,", "2,0.123456789"]
    path = f"file://{tmp_path}/ck"
    for step in range(7):
        assert sinks.save_checkpoint(rows, path, step, keep=3)
    assert not sinks.save_checkpoint(rows, path, 6) and sinks.checkpoint_steps(spark, path) == [4, 5, 6]
    assert sinks.load_checkpoint(spark, path).first()["step"] == 6


LANE = "id bigint, lane bigint, last boolean"


def feed(spark, path, ids, lane=0, last=False):
    """A file of a lane's rows, and perhaps of its end."""
    rows = [(i, lane, False) for i in ids] + [(None, lane, True)] * last
    spark.createDataFrame(rows, LANE).coalesce(1).write.mode("append").parquet(f"{path}/in")


def given(spark, path, **how):
    stream = spark.readStream.schema(LANE).parquet(f"{path}/in")
    return stateful.run_available(stateful.shuffle_buffer(stream, 16, 3, **how), f"{path}/out").orderBy("lane", "turn").toPandas()


def test_shuffle_buffer_waits_is_bounded_and_drains(spark, tmp_path):
    path = f"file://{tmp_path}"
    feed(spark, path, range(7))
    assert len(given(spark, path, least=8)) == 0  # not filled yet
    feed(spark, path, range(7, 40))
    out = given(spark, path, least=8)
    assert len(out) == 32  # eight stay
    feed(spark, path, [40])
    assert len(given(spark, path, least=8)) == 33  # it has been filled: no wait
    feed(spark, path, range(41, 60))
    feed(spark, path, range(100, 103), lane=1)
    feed(spark, path, range(103, 105), lane=1, last=True)
    feed(spark, path, [], last=True)
    out = given(spark, path, least=8)
    one, two = out[out.lane == 0], out[out.lane == 1]
    assert sorted(one.id) == list(range(60)) and one.turn.tolist() == list(range(60)) and sorted(two.id) == list(range(100, 105))
    assert sorted(one.arrived) == list(range(60)) and (one.turn > one.arrived - 16).all() and (one.id != one.turn).any()
    assert one.id.tolist()[:33] == given(spark, path, least=8).query("lane == 0").id.tolist()[:33]  # nothing is given twice
    with pytest.raises(ValueError):
        stateful.shuffle_buffer(spark.createDataFrame([], LANE), 4, 1, least=5)


def test_lagged_counts_go_on_after_a_restart(spark, tmp_path):
    r = np.random.default_rng(0)
    steps = np.sort(np.append(r.integers(0, 30, 400), [5] * 30))
    steps = steps[(steps < 9) | (steps > 11)]  # a gap of steps
    rows = [(int(s), int(b), False) for s, b in zip(steps, r.integers(0, 4, len(steps)))]
    cut = next(i for i, x in enumerate(rows) if x[0] == 17) + 3  # within a step
    path = f"file://{tmp_path}"
    for k, part in enumerate((rows[:cut], rows[cut:], [(None, b, True) for b in range(4)])):
        spark.createDataFrame(part, "step bigint, bucket bigint, last boolean").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("step bigint, bucket bigint, last boolean").parquet(f"{path}/in")
        pairs = stateful.run_available(stateful.lagged_counts(stream), f"{path}/out")
    count = {}
    for s, b, _ in rows:
        count[s, b] = count.get((s, b), 0) + 1
    assert {(x["step"], x["bucket"]): (x["n"], x["before"]) for x in pairs.collect()} == {(s, b): (n, count.get((s - 1, b), 0)) for (s, b), n in count.items()}
    hist = spark.createDataFrame([(s, b, n) for (s, b), n in count.items()], "step bigint, bucket bigint, n bigint")
    acf = lambda x: {q["step"]: round(q["acf"], 9) for q in x.collect()}
    assert acf(diagnostics.correlation_of_pairs(pairs, 4)) == acf(diagnostics.lag1_correlation(hist, 4))
