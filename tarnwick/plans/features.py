"""Feature queries: waveforms stand in as ``embeddings`` vectors and as tones made from event values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import augment as G
from ..functions import signal as S
from ..operators import loader, sampling
from .registry import query, table


@query("SELECT vec_id, embedding[8:57] AS cropped, list_concat(list_concat(list_transform(range(8), lambda i: 0::FLOAT), embedding), list_transform(range(9), lambda i: 0::FLOAT)) AS padded FROM embeddings")
def center_crop(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.center_crop(F.col("embedding"), 50).alias("cropped"), A.center_crop(F.col("embedding"), 81).alias("padded"))


@query("SELECT vec_id, embedding[1:16] AS head, embedding[49:64] AS tail, list_concat(embedding, list_transform(range(6), lambda i: 0::FLOAT)) AS padded FROM embeddings")
def truncate_modes(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", A.truncate(e, 16, "start").alias("head"), A.truncate(e, 16, "end").alias("tail"), A.truncate(e, 70, "start").alias("padded"))


_MOD = "18446744073709551616::UHUGEINT"
_MUL = "(({a} % 4294967296::UHUGEINT) * {b} + ((({a} >> 32) * ({b} % 4294967296::UHUGEINT)) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % " + _MOD


@query(f"""WITH s0 AS (SELECT event_id, event_id::UHUGEINT AS i, (7 + event_id)::UHUGEINT AS seed FROM events),
s1 AS (SELECT event_id, (xor(seed, {_MUL.format(a='i', b='15485863658909301139::UHUGEINT')}) + 11400714819323198485::UHUGEINT) % {_MOD} AS z FROM s0),
s2 AS (SELECT event_id, {_MUL.format(a='xor(z, z >> 30)', b='13787848793156543929::UHUGEINT')} AS z FROM s1),
s3 AS (SELECT event_id, {_MUL.format(a='xor(z, z >> 27)', b='10723151780598845931::UHUGEINT')} AS z FROM s2)
SELECT event_id, CAST(xor(z, z >> 31) % 48001::UHUGEINT AS BIGINT) AS start FROM s3""".replace("15485863658909301139", str(sampling.INDEX_MULTIPLIER)))
def random_crop_start(spark, sf_dir):
    with sampling.wrapping_arithmetic(spark):
        e = table(spark, sf_dir, "events")
        start = sampling.crop_start(F.col("event_id") + 7, F.col("event_id"), F.lit(48000).cast("bigint"))
        out = e.select("event_id", start.alias("start"))
        out.schema  # resolve while arithmetic wraps
    return out


@query("""SELECT vec_id, p // 2 AS row, p % 2 AS col, list_concat(embedding[(p // 2) * 16 + (p % 2) * 4 + 1 : (p // 2) * 16 + (p % 2) * 4 + 4], embedding[(p // 2) * 16 + 8 + (p % 2) * 4 + 1 : (p // 2) * 16 + 8 + (p % 2) * 4 + 4]) AS px
FROM embeddings, (SELECT unnest(range(8))::INT AS p)""")
def patchify(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.inline(A.patchify(F.col("embedding"), 8, 8, 2, 4)))


@query("SELECT vec_id, embedding AS image FROM embeddings")
def unpatchify(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", A.patchify(F.col("embedding"), 8, 8, 2, 4).alias("p"))
    return p.select("vec_id", A.unpatchify(F.col("p"), 8, 8, 2, 4).alias("image"))


@query("SELECT vec_id, list_concat(embedding[1:8], embedding[25:32]) AS kept FROM embeddings")
def filter_time(spark, sf_dir):
    active = F.array(*(F.lit(k in (1, 13)) for k in range(32)))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.active_segments(F.col("embedding"), active, per_time=4, samples=8).alias("kept"))


@query("SELECT vec_id, list_transform(range(16), lambda i: round((embedding[4 * i + 1]::DOUBLE + embedding[4 * i + 2]::DOUBLE + embedding[4 * i + 3]::DOUBLE + embedding[4 * i + 4]::DOUBLE) / 4, 6)) AS mono FROM embeddings")
def mono_mix(spark, sf_dir):
    m = A.mono(F.transform("embedding", lambda x: x.cast("double")), F.lit(4))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(m, lambda x: A.rounded(x, 6)).alias("mono"))


@query("SELECT vec_id, list_transform(range(8), lambda i: embedding[8 * i + 1 : 8 * i + 8]) AS f FROM embeddings")
def framing(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.frames(F.col("embedding"), 8, 8).alias("f"))


@query("""SELECT p_partkey, round(1127 * ln(1 + p_retailprice::DOUBLE * 10 / 700), 6) AS natural, round(2595 * log10(1 + p_retailprice::DOUBLE * 10 / 700), 6) AS decimal FROM part""")
def mel_scale(spark, sf_dir):
    hz = F.col("p_retailprice").cast("double") * 10
    return table(spark, sf_dir, "part").select("p_partkey", A.rounded(A.mel(hz), 6).alias("natural"), A.rounded(A.mel(hz, False), 6).alias("decimal"))


#: Samples of a wave, one second.
TONE_RATE = 16000


def tones(spark, sf_dir):
    """(event_id, hz, strength) of every event: what :func:`wave` makes a sine of one second of.  Whole tones a rate apart are the same samples, so ``hz`` lies below the rate."""
    hz = F.pmod((200 + F.col("event_id") * 20).cast("double"), F.lit(float(TONE_RATE)))
    return table(spark, sf_dir, "events").select("event_id", hz.alias("hz"), ((1 + F.col("value") % 5) / 8).cast("double").alias("strength"))


@lru_cache(4)
def _sines(rate: int) -> np.ndarray:
    """A round of a sine of ``rate`` places."""
    return np.sin(2 * np.pi * np.arange(rate) / rate)


def wave(hz: float, strength: float, rate: int = TONE_RATE) -> np.ndarray:
    """One second of a sine.  Of whole ``hz``, its places in the round are exact and tabled, so that a high tone costs and errs no more than a low one; they come again and again."""
    if hz % 1 == 0:
        step = int(hz) % rate
        some = rate // math.gcd(step, rate)
        return np.tile((_sines(rate)[step * np.arange(some) % rate] * strength).astype(np.float32), rate // some)
    return (np.sin(2 * np.pi * hz * np.arange(rate) / rate) * strength).astype(np.float32)


def of_tones(events, f, kind: str):
    """(event_id, m) of every row of ``events`` (see :func:`tones`): m is what ``f`` gives for its wave.

    Rows of one hz and strength have the same wave, so each different one is made once, where it is used and one at a time, and m is joined to all its rows.
    """

    @F.pandas_udf(kind)
    def run(hz: pd.Series, strength: pd.Series) -> pd.Series:
        out = [f(wave(*x)) for x in zip(hz, strength, strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")]) if "," in kind else pd.Series(out)

    # rows are small and waves are long: what is a small table is spread before it grows
    different = events.select(F.col("hz").alias("of_hz"), F.col("strength").alias("of_strength")).distinct().repartition(4 * events.sparkSession.sparkContext.defaultParallelism)
    made = different.select("of_hz", "of_strength", run("of_hz", "of_strength").alias("m"))
    same = F.col("hz").eqNullSafe(F.col("of_hz")) & F.col("strength").eqNullSafe(F.col("of_strength"))
    return events.join(made, same, "left").select("event_id", "m")


@query()
def fbank_stats(spark, sf_dir):
    stats = of_tones(tones(spark, sf_dir), lambda x: S.log_mel_range(x, TONE_RATE, n_mels=64), "n int, top float, low float")
    return stats.select("event_id", "m.*")


@query("SELECT event_id, 512 * 128 AS n FROM events")
def clip_feature_size(spark, sf_dir):
    return of_tones(tones(spark, sf_dir), lambda x: S.clip_features(x, 32000).size, "int").withColumnRenamed("m", "n")


@query("SELECT event_id, 22050 AS n FROM events")
def resample_len(spark, sf_dir):
    return of_tones(tones(spark, sf_dir), lambda x: len(S.resample(x, TONE_RATE, 22050)), "int").withColumnRenamed("m", "n")


_PLACE = "(256 * (j - CAST(floor(t) AS BIGINT) + 127 + 1) - ({p}))"
_TAP = """CASE WHEN {q} BETWEEN 0 AND 65535 THEN power(0.35875::DOUBLE - 0.48829::DOUBLE * cos(2 * pi() * {q} / 65536.0::DOUBLE) + 0.14128::DOUBLE * cos(4 * pi() * {q} / 65536.0::DOUBLE)
  - 0.01168::DOUBLE * cos(6 * pi() * {q} / 65536.0::DOUBLE), 2) * CASE WHEN {q} = 32768 THEN 1 ELSE sin(pi() * ({q} - 32768) * c / 256) / (pi() * ({q} - 32768) * c / 256) END ELSE 0 END"""


def _resampled(source: int, target: int, n: int = 64) -> str:
    """SQL of each vector's samples resampled by a direct sum of tabled taps."""
    out = int(n * target / source + 0.5)
    return f"""WITH c AS (SELECT 0.95::DOUBLE * least(1, {target} / {source}::DOUBLE) AS c), w AS (SELECT sum({_TAP.format(q='q')}) / 256 AS total FROM c, (SELECT unnest(range(65536)) AS q)),
k AS (SELECT k, k * ({source} / {target}::DOUBLE) AS t FROM (SELECT unnest(range({out})) AS k)), p AS (SELECT *, least(CAST(floor((t - floor(t)) * 256) AS BIGINT), 255) AS p FROM k),
j AS (SELECT k, t, p, (t - floor(t)) * 256 - p AS share, j FROM p, (SELECT unnest(range({n})) AS j)),
m AS (SELECT k, j, share, c, {_PLACE.format(p='p')} AS a, {_PLACE.format(p='p + 1')} AS b FROM j, c WHERE j BETWEEN floor(t) - 127 AND floor(t) + 128),
taps AS (SELECT k, j, ((1 - share) * ({_TAP.format(q='a')}) + share * ({_TAP.format(q='b')})) / total AS tap FROM m, w),
v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT vec_id, list(y ORDER BY k) AS y FROM (SELECT vec_id, k, round(sum(x * tap), 7) + 0.0 AS y FROM v JOIN taps USING (j) GROUP BY vec_id, k) GROUP BY vec_id"""


for _source, _target in ((16000, 22050), (44100, 32003)):

    @query(_resampled(_source, _target), f"resample_{_source}_{_target}")
    def _resample(spark, sf_dir, source=_source, target=_target):
        exact = S.array_udf(lambda x: S.resample(x, source, target), "double")
        return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(exact("embedding"), lambda y: A.rounded(y, 7) + F.lit(0.0)).alias("y"))


@query("SELECT vec_id, CAST(floor(64 * (vec_id % 10) / 10.0) AS BIGINT) AS masked FROM embeddings")
def block_mask_count(spark, sf_dir):
    @F.pandas_udf("bigint")
    def count(ids):
        return ids.map(lambda i: int(S.block_mask(8, 8, 2, (i % 10) / 10, i).sum()))

    return table(spark, sf_dir, "embeddings").select("vec_id", count("vec_id").alias("masked"))


@query("""WITH m AS (SELECT vec_id, CAST(floor(64 * (vec_id % 10) / 10.0) AS INT) AS masked FROM embeddings)
SELECT vec_id, masked, masked // 4 AS whole_blocks, CAST(masked % 4 AS INT) AS single, true AS again FROM m""")
def block_mask_blocks(spark, sf_dir):
    """Masked patches lie in as many whole blocks as fit, the rest alone; the same seed masks the same ones."""

    @F.pandas_udf("masked int, whole_blocks int, single int, again boolean")
    def counts(ids: pd.Series) -> pd.DataFrame:
        out = []
        for i in ids:
            mask = S.block_mask(8, 8, 2, (i % 10) / 10, i)
            blocks = mask.reshape(4, 2, 4, 2).sum(axis=(1, 3))
            out.append((mask.sum(), (blocks == 4).sum(), blocks[blocks < 4].sum(), (mask == S.block_mask(8, 8, 2, (i % 10) / 10, i)).all()))
        return pd.DataFrame(out, columns=["masked", "whole_blocks", "single", "again"])

    return table(spark, sf_dir, "embeddings").select("vec_id", counts("vec_id").alias("m")).select("vec_id", "m.*")


_AUGMENTS = {
    "crop": G.random_crop(1), "flip": G.flip(), "noise": G.noise(), "freq_mask": G.freq_mask(3), "time_mask": G.time_mask(3), "resized_crop": G.resized_crop(),
    "jitter": G.jitter(), "blur": G.blur(), "solarize": G.solarize(p=1.0),
}


@query("SELECT vec_id, name, 64 AS n FROM embeddings, (SELECT unnest(['crop', 'flip', 'noise', 'freq_mask', 'time_mask', 'resized_crop', 'jitter', 'blur', 'solarize', 'all']) AS name)")
def augment_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    seed = lambda name: F.xxhash64(F.lit(name), "vec_id")
    one = {k: F.size(G.augmented([v], 8, 8)("embedding", seed(k))) for k, v in _AUGMENTS.items()}
    one["all"] = F.size(G.augmented(list(_AUGMENTS.values()), 8, 8)("embedding", seed("all")))
    wide = e.select("vec_id", F.array(*(F.struct(F.lit(k).alias("name"), v.alias("n")) for k, v in one.items())).alias("x"))
    return wide.select("vec_id", F.inline_outer("x"))  # inline brings a filter for empty arrays, which would call all functions again


@query("SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > 0.1::DOUBLE THEN (1 - x::DOUBLE)::FLOAT ELSE x END) AS v FROM embeddings")
def augment_solarize(spark, sf_dir):
    out = G.augmented([G.solarize(0.1, 1.0)], 8, 8)("embedding", F.lit(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", out.alias("v"))


_PIXELS = "v AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"
_IMAGE = "list(round(x, 5) + 0.0 ORDER BY r, c) AS v"


def _augmented(spark, sf_dir, *steps):
    out = G.augmented(list(steps), 8, 8, "double")("embedding", F.lit(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(out, lambda x: A.rounded(x, 5) + F.lit(0.0)).alias("v"))


@query(f"""WITH {_PIXELS}, m AS (SELECT vec_id, avg(x * 1.3::DOUBLE) AS m FROM v GROUP BY vec_id), a AS (SELECT vec_id, r, c, (x * 1.3::DOUBLE - m) * 0.6::DOUBLE + m AS x FROM v JOIN m USING (vec_id))
SELECT vec_id, {_IMAGE} FROM a GROUP BY vec_id""")
def augment_adjusted(spark, sf_dir):
    return _augmented(spark, sf_dir, lambda x, r: G.adjusted(x, 1.3, 0.6))


@query(f"""WITH {_PIXELS}, k AS (SELECT d, exp(-0.5::DOUBLE * power(d / 0.7::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * power(d / 0.7::DOUBLE, 2))) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS d)),
g AS (SELECT i, CASE WHEN i + d < 0 THEN -i - d - 1 WHEN i + d > 7 THEN 15 - i - d ELSE i + d END AS j, w FROM k, (SELECT unnest(range(8)) AS i)),
a AS (SELECT vec_id, i AS r, c, sum(x * w) AS x FROM v JOIN g ON r = j GROUP BY ALL), b AS (SELECT vec_id, r, i AS c, sum(x * w) AS x FROM a JOIN g ON c = j GROUP BY ALL)
SELECT vec_id, {_IMAGE} FROM b GROUP BY vec_id""")
def augment_blurred(spark, sf_dir):
    return _augmented(spark, sf_dir, G.blur(0.7, 0.7))


@query(f"""WITH {_PIXELS}, g AS (SELECT i, n, i * (n - 1) / 7.0::DOUBLE AS y FROM (SELECT unnest(range(8)) AS i), (SELECT unnest([5, 4]) AS n)),
w AS (SELECT n, i, j, CASE WHEN j = floor(y) THEN 1 - (y - floor(y)) ELSE y - floor(y) END AS w FROM g, (SELECT unnest(range(5)) AS j) WHERE j < n AND j IN (floor(y), floor(y) + 1)),
a AS (SELECT vec_id, i AS r, c, sum(x * w) AS x FROM v JOIN w ON n = 5 AND r = j + 1 GROUP BY ALL), b AS (SELECT vec_id, r, i AS c, sum(x * w) AS x FROM a JOIN w ON n = 4 AND c = j + 2 GROUP BY ALL)
SELECT vec_id, {_IMAGE} FROM b GROUP BY vec_id""")
def augment_resized(spark, sf_dir):
    return _augmented(spark, sf_dir, lambda x, r: G.resized(x, 1, 2, 5, 4))


@query(f"""WITH {_PIXELS}, f AS (SELECT vec_id, r, 7 - c AS c, CASE WHEN x > 0.05::DOUBLE THEN 1 - x ELSE x END AS x FROM v), m AS (SELECT vec_id, avg(x * 0.5::DOUBLE) AS m FROM f GROUP BY vec_id),
a AS (SELECT vec_id, r, c, (x * 0.5::DOUBLE - m) * 2 + m AS x FROM f JOIN m USING (vec_id))
SELECT vec_id, {_IMAGE} FROM a GROUP BY vec_id""")
def augment_in_turn(spark, sf_dir):
    return _augmented(spark, sf_dir, G.flip(1.0), G.solarize(0.05, 1.0), lambda x, r: G.adjusted(x, 0.5, 2.0))


def _mixing(seed: str, index: str, source: str) -> str:
    """SQL tables s0 to s3 of which the last has z, the 64-bit mixing of (seed xor index * multiplier), beside the columns of ``source``."""
    return f"""s0 AS (SELECT *, ({index})::UHUGEINT AS i, ({seed})::UHUGEINT AS seed FROM {source}),
s1 AS (SELECT *, (xor(seed, {_MUL.format(a='i', b=f'{sampling.INDEX_MULTIPLIER}::UHUGEINT')}) + 11400714819323198485::UHUGEINT) % {_MOD} AS z1 FROM s0),
s2 AS (SELECT *, {_MUL.format(a='xor(z1, z1 >> 30)', b='13787848793156543929::UHUGEINT')} AS z2 FROM s1),
s3 AS (SELECT *, {_MUL.format(a='xor(z2, z2 >> 27)', b='10723151780598845931::UHUGEINT')} AS z3 FROM s2), mixed AS (SELECT *, xor(z3, z3 >> 31) AS z FROM s3)"""


@query(f"""WITH e AS (SELECT event_id, epoch FROM events, (SELECT unnest(range(3))::INT AS epoch)), {_mixing('7 + event_id + epoch', 'event_id', 'e')}
SELECT event_id, epoch, CAST(z % 48001::UHUGEINT AS BIGINT) AS start FROM mixed""")
def epoch_crops(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"))
    return loader.epoch_crops(rows, 7, 3, 48000).withColumnRenamed("index", "event_id")


@query(f"""WITH r AS (SELECT event_id, event_id // 1000 AS shard FROM events), {_mixing('7 + 2', 'shard', 'r')}
SELECT event_id, shard FROM mixed ORDER BY z, event_id LIMIT 2500""")
def loader_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), F.expr("event_id div 1000").alias("shard"))
    return loader.sent_rows(rows, 7, 2, 2500).select(F.col("index").alias("event_id"), "shard")


@query("SELECT vec_id, list_concat(list_concat(embedding[9:16], embedding[25:32]), embedding[49:64]) AS px FROM embeddings")
def visible_patches(spark, sf_dir):
    patches = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))
    masked = F.array(*(F.lit(k in (0, 2, 4, 5)) for k in range(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(A.visible(patches, masked)).alias("px"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS k FROM v)
SELECT vec_id, list(CAST(i AS INT) ORDER BY i) AS chosen FROM r WHERE k <= 12 GROUP BY vec_id""")
def exact_mask(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.lowest(F.col("embedding"), 12).alias("chosen"))


@query("SELECT vec_id, list_transform(range(8), lambda k: round(list_avg(list_transform(range(8), lambda t: embedding[t * 8 + k + 1]::DOUBLE)), 6)) AS pooled FROM embeddings")
def mean_pool(spark, sf_dir):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform(F.slice("embedding", t * 8 + 1, 8), lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(A.mean_pool(tokens, 8), lambda x: A.rounded(x, 6)).alias("pooled"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 255) AS BIGINT) % 256) AS c FROM embeddings)
SELECT vec_id, list_transform(range(21), lambda i: round(((0.299::DOUBLE * c[3 * i + 1] + 0.587::DOUBLE * c[3 * i + 2] + 0.114::DOUBLE * c[3 * i + 3]) / 255 - 0.4914::DOUBLE) / 0.2470::DOUBLE, 6)) AS grey FROM e""")
def gray_values(spark, sf_dir):
    colours = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255) % 256)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(A.gray(colours), lambda x: A.rounded(x, 6)).alias("grey"))


@query("""WITH v AS (SELECT vec_id, (i - 1) // 8 AS p, (i - 1) % 8 AS j, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
a AS (SELECT vec_id, 7 - p AS p, j, x, avg(x) OVER w AS m, var_pop(x) OVER w AS s FROM v WINDOW w AS (PARTITION BY vec_id, p)),
e AS (SELECT vec_id, p, avg(power(v.x - (a.x - m) / sqrt(s + 1e-6::DOUBLE), 2)) AS x FROM v JOIN a USING (vec_id, p, j) GROUP BY ALL)
SELECT vec_id, round(sum(CASE WHEN (vec_id + p) % 3 = 0 THEN x END) / count(CASE WHEN (vec_id + p) % 3 = 0 THEN 1 END), 6) AS error FROM e GROUP BY vec_id""")
def masked_patch_error(spark, sf_dir):
    """Mean squared error of masked patches, predicted by the vector's own ones in reverse."""
    patches = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.slice("embedding", k * 8 + 1, 8), lambda x: x.cast("double")))
    masked = F.array(*((F.col("vec_id") + k) % 3 == 0 for k in range(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.rounded(A.masked_error(patches, F.reverse(patches), masked), 6).alias("error"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS s FROM v GROUP BY vec_id)
SELECT vec_id, list(round((x - m) / sqrt(s + 1e-6::DOUBLE), 5) ORDER BY i) AS normal FROM v JOIN m USING (vec_id) GROUP BY vec_id""")
def layer_norm(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(A.layer_norm(x), lambda v: A.rounded(v, 5)).alias("normal"))


@query("SELECT vec_id, list_reduce(list_transform(range(8), lambda r: list_transform(range(8), lambda c: embedding[r * 8 + 8 - c])), lambda a, b: list_concat(a, b)) AS v FROM embeddings")
def augment_flip(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", G.augmented([G.flip(1.0)], 8, 8)("embedding", F.xxhash64("vec_id")).alias("v"))


@query("SELECT vec_id, true AS rows_whole_or_zero, true AS columns_whole_or_zero, true AS cropped_inside FROM embeddings")
def augment_laws(spark, sf_dir):
    """Masks leave a line as it is or empty it, and a crop moves values by at most its padding."""
    seed = lambda name: F.xxhash64(F.lit(name), "vec_id")
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", G.augmented([G.freq_mask(3)], 8, 8)("embedding", seed("f")).alias("f"), G.augmented([G.time_mask(3)], 8, 8)("embedding", seed("t")).alias("t"),
        G.augmented([G.random_crop(1)], 8, 8)("embedding", seed("c")).alias("c"),
    )
    line = lambda a, at: F.transform(F.array(*map(F.lit, at)), lambda i: a[i])
    whole = lambda a, at: (line(F.col(a), at) == line(F.col("embedding"), at)) | F.forall(line(F.col(a), at), lambda x: x == 0)
    every = lambda tests: F.forall(F.array(*tests), lambda x: x)
    moved = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            source = [(r + dy) * 8 + c + dx if 0 <= r + dy < 8 and 0 <= c + dx < 8 else -1 for r in range(8) for c in range(8)]
            want = F.array(*(F.lit(0.0).cast("float") if k < 0 else F.col("embedding")[k] for k in source))
            moved.append(F.col("c") == want)
    return e.select(
        "vec_id", every([whole("f", range(8 * r, 8 * r + 8)) for r in range(8)]).alias("rows_whole_or_zero"),
        every([whole("t", range(c, 64, 8)) for c in range(8)]).alias("columns_whole_or_zero"), F.exists(F.array(*moved), lambda x: x).alias("cropped_inside"),
    )
