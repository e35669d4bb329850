import io
import wave

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.functions import arrays as A
from tarnwick.functions import augment as G
from tarnwick.functions import signal as S


def wav(x, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(x.tobytes())
    return out.getvalue()


def test_frames_and_sine():
    x = np.sin(2 * np.pi * 1000 * np.arange(160000) / 32000).astype(np.float32)
    m = S.log_mel(x)
    assert m.shape == (498, 128)
    centres = 700 * np.expm1(np.linspace(*(1127 * np.log1p(np.array([20, 16000]) / 700)), 130)[1:-1] / 1127)
    assert abs(centres[m.mean(axis=0).argmax()] - 1000) < 60
    assert S.log_mel(np.zeros(100)).shape == (0, 128)
    assert np.allclose(S.log_mel(np.zeros(1600), 16000), np.log(np.finfo(np.float32).eps))


def test_log_mel_against_direct_sum():
    x = np.random.default_rng(1).normal(size=600)
    got = S.log_mel(x, 8000, n_mels=20)
    f = x[80:280] - x[80:280].mean()
    f = f - 0.97 * np.concatenate([f[:1], f[:-1]])
    f = np.pad(f * np.hanning(200), (0, 56))
    k = np.arange(129)[:, None] * np.arange(256)
    power = np.abs((f * np.exp(-2j * np.pi * k / 256)).sum(axis=1)) ** 2
    want = np.log(np.maximum(S.mel_filters(256, 8000, 20) @ power, np.finfo(np.float32).eps))
    assert np.allclose(got[1], want, rtol=1e-4, atol=1e-3)


def test_clip_features_shape():
    assert S.clip_features(np.random.default_rng(0).normal(size=1000)).shape == (512, 128)


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 12), st.integers(2, 12), st.integers(1, 4), st.floats(0, 0.95), st.integers(0, 99))
def test_block_mask_is_exact(h, w, block, ratio, seed):
    assert S.block_mask(h, w, block, ratio, seed).sum() == int(h * w * ratio)


def test_resample_length_and_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100).astype(np.float32)
    y = S.resample(x, 44100, 22050)
    assert len(y) == 22050
    want = np.sin(2 * np.pi * 440 * np.arange(22050) / 22050)
    assert np.abs(y - want)[200:-200].max() < 1e-2
    assert S.resample(x, 8000, 8000) is x


@pytest.mark.parametrize("source, target", [(8000, 16000), (44100, 32000), (44100, 32003), (48000, 32000), (22050, 7919)])
def test_resample_against_a_direct_sum(source, target):
    x = np.random.default_rng(0).standard_normal(700)
    n, cut = 256 * 256, 0.95 * min(1, target / source)
    q = np.arange(n)
    window = 0.35875 - 0.48829 * np.cos(2 * np.pi * q / n) + 0.14128 * np.cos(4 * np.pi * q / n) - 0.01168 * np.cos(6 * np.pi * q / n)
    table = np.append(window**2 * np.sinc((q - n // 2) * cut / 256), 0)
    table /= table.sum() / 256
    want = np.zeros(int(len(x) * target / source + 0.5))
    for k in range(len(want)):
        t = k * source / target
        i, p = int(t), min(int((t - int(t)) * 256), 255)
        share = (t - i) * 256 - p
        for m in range(256):
            if 0 <= (j := i - 127 + m) < len(x):
                want[k] += x[j] * ((1 - share) * table[256 * (m + 1) - p] + share * table[256 * (m + 1) - p - 1])
    assert np.allclose(S.resample(x, source, target), want, atol=1e-12)
    assert np.allclose(S.resample(x.astype(np.float32), source, target), want, atol=1e-4)


def test_decode(spark):
    x = np.array([0, 16384, -32768, 100], np.int16)
    rows = spark.createDataFrame([(1, bytearray(wav(x, channels=2))), (2, bytearray(b"junk")), (3, bytearray(wav(x[:0])))], "id int, data binary")
    got = {r["id"]: r["d"] for r in rows.select("id", S.decode_audio("data").alias("d")).collect()}
    assert got[1]["ok"] and got[1]["channels"] == 2 and got[1]["samples"] == pytest.approx([0, 0.5, -1, 100 / 32768])
    assert not got[2]["ok"] and not got[3]["ok"]
    assert S.pcm(bytes([0, 128, 255]), 1) == pytest.approx([-1, 0, 127 / 128])
    with pytest.raises(ValueError):
        S.pcm(b"abc", 3)


def column(spark, values, make):
    values = [float(v) for v in values]
    return spark.createDataFrame([(values,)], "a array<float>").select(make(F.col("a"))).first()[0]


@pytest.mark.parametrize("n,want", [(2, [2, 3]), (7, [0, 1, 2, 3, 4, 0, 0]), (4, [1, 2, 3, 4])])
def test_center_crop(spark, n, want):
    assert column(spark, [1.0, 2, 3, 4], lambda a: A.center_crop(a, n)) == want


def test_truncate(spark):
    assert column(spark, [1.0, 2, 3, 4], lambda a: A.truncate(a, 2, "end")) == [3, 4]
    assert column(spark, [1.0, 2, 3, 4], lambda a: A.truncate(a, 2, "random", F.lit(3))) == [2, 3]
    assert column(spark, [1.0], lambda a: A.truncate(a, 2, "random", F.lit(3))) == [1, 0]


def test_mono_drops_part_of_a_frame(spark):
    assert column(spark, [1.0, 3, 5, 7, 9], lambda a: A.mono(a, F.lit(2))) == [2, 6]


@pytest.mark.parametrize("h,w,ph,pw", [(4, 6, 2, 3), (8, 8, 8, 2), (2, 2, 1, 1)])
def test_patches_round_trip(spark, h, w, ph, pw):
    x = [float(i) for i in range(h * w)]
    assert column(spark, x, lambda a: A.unpatchify(A.patchify(a, h, w, ph, pw), h, w, ph, pw)) == x


def test_active_segments(spark):
    got = column(spark, [float(i) for i in range(12)], lambda a: A.active_segments(a, F.array(*map(F.lit, [False, True, False, False, True, True])), 2, 4))
    assert got == [0, 1, 2, 3, 8, 9, 10, 11]


@pytest.mark.parametrize("step", [G.random_crop(2), G.flip(), G.noise(), G.freq_mask(3), G.time_mask(3), G.resized_crop(), G.jitter(), G.blur(), G.solarize(p=1.0)])
def test_augmentations_keep_shape_and_repeat(step):
    x = np.random.default_rng(0).random((12, 9))
    one, two = (G.apply_steps(x, [step], 5) for _ in range(2))
    assert one.shape == x.shape and np.array_equal(one, two)


def test_masks_and_blur():
    x = np.ones((30, 40))
    r = np.random.default_rng(3)
    assert all(row.all() or not row.any() for row in G.freq_mask()(x, r))
    assert all(c.all() or not c.any() for c in G.time_mask()(x, r).T)
    assert np.allclose(G.blur()(x, r), 1)
    assert np.allclose(G._zoom(np.add.outer(np.arange(4.0), np.arange(3.0)), 7, 5)[::2, ::2], np.add.outer(np.arange(4.0), np.arange(3.0)))


def test_masked_error(spark):
    row = spark.createDataFrame([([[1.0, -1.0], [5.0, 5.0]], [[2.0, 0.0], [1.0, 2.0]], [True, False])], "p array<array<double>>, q array<array<double>>, m array<boolean>")
    assert row.select(A.masked_error(F.col("p"), F.col("q"), F.col("m"))).first()[0] == pytest.approx(0, abs=1e-6)


def test_load_clips(spark):
    from tarnwick.operators.loader import load_clips, with_crop_starts

    x = (np.sin(np.arange(44100 * 6) / 20) * 20000).astype(np.int16)
    rows = spark.createDataFrame([(1, 7, bytearray(wav(x, 44100))), (2, None, bytearray(b"RIFFjunk"))], "index bigint, label bigint, bytes binary")
    got = {r["index"]: r for r in load_clips(rows, seed=3).collect()}
    assert got[1]["ok"] and len(got[1]["features"]) == 512 * 128 and got[1]["label"] == 7
    assert not got[2]["ok"] and got[2]["features"] is None
    starts = [r["start"] for r in with_crop_starts(spark.range(50).withColumnRenamed("id", "index"), 5, 9).collect()]
    assert min(starts) >= 0 and max(starts) <= 9 and len(set(starts)) > 5


def test_floating_point_wav():
    x = np.array([0.25, -0.5, 1.5], "<f4")
    head = struct.pack("<HHIIHH", 3, 1, 16000, 64000, 4, 32)
    data = b"RIFF\0\0\0\0WAVE" + b"LIST\3\0\0\0abc\0" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", x.nbytes) + x.tobytes()
    got, rate, channels = S.decode(data)
    assert got.tolist() == x.tolist() and (rate, channels) == (16000, 1)
    with pytest.raises(ValueError):
        S.decode(data.replace(struct.pack("<H", 3), struct.pack("<H", 7), 1))
    assert S.audio_array({"array": [0.5, 1.0]}).tolist() == [0.5, 1.0] and S.audio_array({"bytes": data}).tolist() == x.tolist()
    assert S.audio_array({"array": [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]}).tolist() == [0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        S.audio_array({"path": "x"})


def test_energy_places_and_layout():
    x = np.random.default_rng(1).standard_normal(16000).astype(np.float32)
    plain = S.log_mel(x, 16000, n_mels=23)
    first, last, damped = (S.log_mel(x, 16000, n_mels=23, energy=True, **o) for o in ({}, {"energy_last": True}, {"raw_energy": False}))
    assert (first[:, 1:] == plain).all() and (last[:, :-1] == plain).all() and (first[:, 0] == last[:, -1]).all()
    assert (damped[:, 0] < first[:, 0]).all() and S.mel_by_frame(x, 16000, n_mels=23).shape == S.mel_shape(16000, 16000, n_mels=23) == plain.T.shape


def slow_filter(x, active):
    """Patch by patch, bin by bin, frame by frame."""
    x = np.pad(x[:160000], (0, max(0, 160000 - len(x))))
    w = np.zeros(1024)
    w[112:912] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(800) / 800)
    padded = np.concatenate([x[512:0:-1], x, x[-2:-514:-1]])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    span, out, weight = mel(16000) - mel(20), np.zeros(len(padded)), np.zeros(len(padded))
    freqs = np.linspace(0, 16000, 513)
    for t in range(501):
        mask = np.zeros(513, bool)
        for k in range(8):
            if t // 16 < 32 and active[t // 16 * 8 + k]:
                mask |= (freqs >= hz(mel(20) + k / 8 * span)) & (freqs < hz(mel(20) + (k + 1) / 8 * span))
        at = slice(t * 320, t * 320 + 1024)
        out[at] += np.fft.irfft(np.fft.rfft(padded[at] * w) * mask) * w
        weight[at] += w * w
    y = (out / np.maximum(weight, 1e-11))[512 : 512 + 160000]
    times = sorted({i // 8 for i in np.flatnonzero(active)})
    return np.concatenate([np.zeros(0), *(y[t * 5120 : (t + 1) * 5120] for t in times)])


@pytest.mark.parametrize("n", [160_000, 90_000, 170_000])
def test_filter_of_mel_patches(n):
    r = np.random.default_rng(n)
    x = r.standard_normal(n)
    for active in (r.random(256) < 0.2, np.arange(256) == 77, np.arange(256) >= 248, np.zeros(256, bool)):
        got, want = S.filter_audio(x, active), slow_filter(x, active)
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)
    whole = np.pad(x[:160000], (0, max(0, 160000 - n)))
    assert np.allclose(S.filter_audio(x, np.arange(256) == 9, spectrum=False), whole[5120:10240], atol=1e-6)
    back = S.istft(S.stft(x, 1024, 320, 800), 1024, 320, 800, n)
    assert np.allclose(back[:-512], x[:-512], atol=1e-9)
    with pytest.raises(ValueError):
        S.filter_audio(x, np.ones(8))


def test_crops_follow_one_law(spark):
    from tarnwick.operators.loader import check_indices, sent_rows, with_crop_starts
    from tarnwick.operators.sampling import crop_start_of

    rows = spark.range(200).withColumnRenamed("id", "index")
    assert {r["index"]: r["start"] for r in with_crop_starts(rows, 5, 9).collect()} == {i: crop_start_of(5 + i, i, 9) for i in range(200)}
    sent = sent_rows(rows.withColumn("shard", F.col("index") % 7), 3, 1, 60).collect()
    assert len(sent) == 60 and len({r["shard"] for r in sent}) == 3
    assert [r["index"] for r in sent] == [i for s in dict.fromkeys(r["shard"] for r in sent) for i in range(s, 200, 7)][:60]
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, bytearray(wav(np.ones(4, np.int16)))), (3, bytearray(b""))], "index bigint, bytes binary")
    assert sorted((r["index"], r["attempt"]) for r in check_indices(bad, [1, 2], 2).collect()) == [(1, 1), (1, 2)]


def test_rounding_keeps_the_sign_of_zero_and_takes_halves_away_from_it(spark):
    values = [-0.04, 0.04, -0.0, -0.06, 0.25, -1.75, 2.5]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(A.rounded("v", 1)).collect()]
    want = [-0.0, 0.0, -0.0, -0.1, 0.3, -1.8, 2.5]
    assert got == want and [np.signbit(x) for x in got] == [np.signbit(x) for x in want]


def test_taps_are_divided_by_a_sum_in_their_order():
    at = np.arange(65536) - 32768.0
    taps = S.blackman_harris(65536) ** 2 * np.sinc(at * 0.95 / 256)
    total = 0.0
    for x in taps.tolist():
        total += x
    assert S.sinc_table(22050 / 16000)[0, 127] == taps[32768] / (total / 256)
