"""Values that queries give only as sizes or laws, and rarely met cases."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_functions import wav

from tarnwick.functions import augment as G
from tarnwick.functions import signal as S
from tarnwick.operators import diagnostics as D
from tarnwick.operators import evaluation as E
from tarnwick.operators import sinks
from tarnwick.operators.loader import load_clips
from tarnwick.plans import features as P
from tarnwick.plans.features import wave as tone


@pytest.mark.parametrize("n", [0, 900, 160_000, 200_000])
def test_clip_features_by_definition(n):
    x = np.random.default_rng(n).standard_normal(n).astype(np.float32)
    whole = np.zeros(160_000, np.float32)
    whole[: min(n, 160_000)] = x[:160_000]
    m = S.log_mel(whole - whole.mean(), 32000)
    assert m.shape == (498, 128)
    want = np.full((512, 128), min(m.min(), 0.0) if not len(m) else m.min())
    want[:498] = m
    assert np.allclose(S.clip_features(x), (want + 7.2) / 8.86, atol=1e-5)


def test_noise_has_its_deviation():
    x = np.zeros((64, 64))
    y = G.apply_steps(x, [G.noise(0.3)], 5)
    assert abs(y.std() - 0.3) < 0.02 and abs(y.mean()) < 0.03 and (y != G.apply_steps(x, [G.noise(0.3)], 6)).any()
    assert (G.apply_steps(x, [G.noise(0.3), G.flip(1.0)], 5) == y[:, ::-1]).all()


def test_random_steps_are_the_fixed_ones_with_drawn_numbers():
    x = np.random.default_rng(0).standard_normal((8, 8))
    r = np.random.default_rng(9)
    assert np.allclose(G.apply_steps(x, [G.jitter(0.5, 0.25)], 9), G.adjusted(x, r.uniform(0.5, 1.5), r.uniform(0.75, 1.25)))
    r = np.random.default_rng(9)
    assert np.allclose(G.apply_steps(x, [G.blur(0.1, 2.0)], 9), G.blurred(x, r.uniform(0.1, 2.0)))
    assert np.allclose(G.resized(x, 0, 0, 8, 8), x) and np.allclose(G.blurred(np.ones((5, 5)), 1.3), 1)


def test_loader_augments_by_recording_and_epoch(spark):
    data = wav((np.sin(np.arange(3000)) * 9000).astype(np.int16))
    rows = spark.createDataFrame([(i, 0, data) for i in range(3)], "index bigint, label bigint, bytes binary")
    load = lambda **how: {r["index"]: np.array(r["features"]) for r in load_clips(rows, rate=8000, seconds=0.3, n_mels=8, seed=1, **how).collect()}
    plain, one, again, later = load(), load(augmentations=[G.noise(0.1)]), load(augmentations=[G.noise(0.1)]), load(augmentations=[G.noise(0.1)], epoch=1)
    assert all((one[i] == again[i]).all() and (one[i] != later[i]).any() and 0.05 < (one[i] - plain[i]).std() < 0.2 for i in range(3))
    assert not np.allclose(one[0] - plain[0], one[1] - plain[1])


def test_scores_of_more_classes_than_are_broadcast(spark, monkeypatch):
    r = np.random.default_rng(0)
    x, c = r.normal(size=(40, 3)), r.normal(size=(11, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    classes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "class_id int, centroid array<double>")
    whole = {(q["id"], q["class_id"]): q["score"] for q in E.class_scores(rows, classes).collect()}
    monkeypatch.setattr(E, "MOST_CLASSES", 4)
    parts = E.class_scores(rows, classes)
    assert "NestedLoop" not in parts._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in parts._jdf.queryExecution().executedPlan().toString()
    assert {(q["id"], q["class_id"]): q["score"] for q in parts.collect()} == pytest.approx(whole) and len(whole) == 440


def test_expected_smaller_count(spark):
    r = np.random.default_rng(0)
    for rate in (0.01, 0.5, 3.0, 80.0):
        got = spark.range(1).select(D.expected_least(F.lit(rate))).first()[0]
        drawn = np.minimum(r.poisson(rate, 400_000), r.poisson(rate, 400_000)).mean()
        assert got == pytest.approx(drawn, rel=0.05, abs=2e-4)
    assert spark.range(1).select(D.expected_least(F.lit(0.5))).first()[0] == pytest.approx(0.163, abs=1e-3)


def test_stats_of_states_without_values(spark):
    rows = [("a", "w", [3.0, -4.0], None), ("a", "z", None, 7), ("a", "b", [], 5), ("b", "k", None, 1), ("c", "w", [0.0], None)]
    got = {r["state"]: tuple(r)[1:] for r in E.optimizer_stats(spark.createDataFrame(rows, "state string, component string, values array<float>, count bigint")).collect()}
    assert got == {"a": (5.0, 3.5, 4.0, [5, 7]), "b": (None, None, None, [1]), "c": (0.0, 0.0, 0.0, [])}


def test_checkpoint_that_was_saved_without_a_configuration(spark, tmp_path):
    state = spark.createDataFrame([("w", [1.0])], "component string, values array<double>")
    path = f"file://{tmp_path}/s"
    assert sinks.save_checkpoint(state, path, 1) and sinks.load_checkpoint(spark, path).count() == 1
    with pytest.raises(ValueError, match="without a configuration"):
        sinks.load_checkpoint(spark, path, {"a": 1})


def test_correlation_leaves_out_buckets_beyond_the_last(spark):
    hist = [(0, 0, 4), (0, 1, 2), (1, 0, 4), (1, 1, 2), (1, 3, 50), (2, 3, 50), (3, 4, 50)]
    got = {r["step"]: r["acf"] for r in D.lag1_correlation(spark.createDataFrame(hist, "step int, bucket bigint, n bigint"), 3).collect()}
    assert got == pytest.approx({0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0})


def test_zeros_after_a_short_recording_are_transformed_once(monkeypatch):
    x, seen, whole = np.random.default_rng(0).standard_normal(16000).astype(np.float32), [], S.log_mel
    monkeypatch.setattr(S, "log_mel", lambda x, *a, **k: seen.append(len(x)) or whole(x, *a, **k))
    padded = np.pad(x, (0, 144_000))
    m = whole(padded - padded.mean(dtype=np.float64), 32000)
    want = (np.pad(m, ((0, 14), (0, 0)), constant_values=m.min()) + 7.2) / 8.86
    assert np.allclose(S.clip_features(x), want, atol=1e-5) and seen == [50 * 320 + 800]


def test_high_tones_err_no_more_than_low_ones():
    low = np.sin(2 * np.pi * 220 * np.arange(16000) / 16000) * 0.5
    assert (tone(1.2e9 + 220, 0.5) == tone(220.0, 0.5)).all() and np.allclose(tone(220.0, 0.5), low, atol=1e-7)  # a multiple of the rate more
    assert np.allclose(tone(220.5, 0.5), np.sin(2 * np.pi * 220.5 * np.arange(16000) / 16000) * 0.5, atol=1e-7)


def test_equal_tones_are_transformed_once_and_given_to_all_their_events(spark, tmp_path):
    rows = [(i, float(v)) for i in (0, 1, 800, 801, 1600, -800, 10**15) for v in (2, 7, 3.5)] + [(0, None), (800, None), (5, float("nan"))]
    spark.createDataFrame(rows, "event_id bigint, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    calls = spark.sparkContext.accumulator(0)

    def stats(x):
        calls.add(1)
        return S.log_mel_range(x, 16000, n_mels=64)

    got = P.of_tones(P.tones(spark, str(tmp_path)), stats, "n int, top float, low float").select("event_id", "m.*").collect()
    want = []
    for i, v in rows:
        m = S.log_mel(tone(200.0 + 20 * i, np.nan if v is None else (1 + v % 5) / 8), 16000, n_mels=64)
        want.append((i, m.size, *(None if np.isnan(x) else float(x) for x in (m.max(), m.min()))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want)) and calls.value == 2 * 2 + 2  # two places and strengths, one without a value and one without a number
    assert sorted(r["event_id"] for r in P.fbank_stats(spark, str(tmp_path)).collect()) == sorted(i for i, _ in rows)


@pytest.mark.parametrize("options", [{}, {"energy": True}, {"energy": True, "raw_energy": False, "energy_last": True}, {"remove_mean": False}, {"dither": 0.1, "seed": 5}])
def test_long_recordings_are_transformed_block_by_block(monkeypatch, options):
    x, seen, rfft = np.random.default_rng(1).standard_normal(16000 * 3) + 0.5, [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda f, *a, **k: seen.append(len(f)) or rfft(f, *a, **k))
    got = S.log_mel(x, 16000, n_mels=40, **options)
    assert max(seen) <= 128 and sum(seen) == len(got) == 298
    f = np.stack([x[160 * t : 160 * t + 400] for t in range(298)]) + options.get("dither", 0) * np.random.default_rng(5).standard_normal((298, 400))
    f -= f.mean(axis=1, keepdims=True) if options.get("remove_mean", True) else 0
    loud = (f * f).sum(axis=1)
    f = (f - 0.97 * np.column_stack([f[:, 0], f[:, :-1]])) * np.hanning(400)
    loud = loud if options.get("raw_energy", True) else (f * f).sum(axis=1)
    want = np.log(np.maximum(np.abs(rfft(f, 512, axis=1)) ** 2 @ S.mel_filters(512, 16000, 40).T, np.finfo(np.float32).eps))
    if options.get("energy"):
        want = np.column_stack([want, np.log(loud)] if options.get("energy_last") else [np.log(loud), want])
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-5)


def test_a_clip_takes_little_more_memory_than_its_features():
    x = np.random.default_rng(2).standard_normal(16000).astype(np.float32)
    S.clip_features(x)  # what is kept for the next one
    tracemalloc.start()
    out = S.clip_features(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.shape == (512, 128) and out.dtype == np.float32 and (out[51:498] == out[50]).all() and (out[498:] == out.min()).all()
    assert most < 3 * out.nbytes


@pytest.mark.parametrize(("rate", "seconds", "n"), [(32000, 5.0, 0), (32000, 5.0, 300), (32000, 5.0, 159_900), (32000, 0.02, 100), (1000, 8.0, 2000), (16000, 7.0, 1000)])
def test_clips_of_any_length_are_filled_up_alike(rate, seconds, n):
    x, size = np.random.default_rng(n).standard_normal(n).astype(np.float32), int(rate * seconds)
    m = S.log_mel(np.pad(x, (0, size - n)) - x.sum(dtype=np.float64) / size, rate)[:512]
    want = np.pad(m, ((0, 512 - len(m)), (0, 0)), constant_values=m.min(initial=0.0))
    assert np.allclose(S.clip_features(x, rate, seconds), (want + 7.2) / 8.86, atol=1e-5)
