"""From encoded recordings to standardised log-mel clips, in one Arrow-batched pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions.augment import Step, apply_steps
from ..sources.shards import read_shards
from .sampling import INDEX_MULTIPLIER, crop_start, crop_start_of, mixed, signed, unsigned_order, wrapping_arithmetic


def with_crop_starts(rows: DataFrame, seed: int, spare: int) -> DataFrame:
    """``rows`` plus ``start``, a crop start of 0 to ``spare`` that only seed and ``index`` decide."""
    with wrapping_arithmetic(rows.sparkSession):
        out = rows.withColumn("start", crop_start(F.col("index") + seed, F.col("index"), F.lit(spare).cast("bigint")))
        out.schema  # resolved while arithmetic wraps
    return out


def sent_rows(rows: DataFrame, seed: int, epoch: int, limit: int | None = None) -> DataFrame:
    """``rows`` (shard, index) in the order of one epoch, with ``place``-making columns ``turn``: shards by a mixing of seed, epoch and number, then index.

    ``limit``: only the first so many, whether they can be decoded or not.
    """
    with wrapping_arithmetic(rows.sparkSession):
        out = rows.withColumn("turn", mixed(F.lit(seed + epoch).bitwiseXOR(F.col("shard") * F.lit(signed(INDEX_MULTIPLIER)))))
        out.schema  # resolved while arithmetic wraps
    out = out.orderBy(*unsigned_order(F.col("turn")), "index")
    return out if limit is None else out.limit(limit)


def epoch_crops(rows: DataFrame, seed: int, epochs: int, spare: int) -> DataFrame:
    """``rows`` once for each ``epoch``, with the ``start`` of its crop: every epoch draws anew."""
    every = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    with wrapping_arithmetic(rows.sparkSession):
        out = every.withColumn("start", crop_start(F.col("index") + F.col("epoch") + seed, F.col("index"), F.lit(spare).cast("bigint")))
        out.schema
    return out


def check_indices(rows: DataFrame, indices: list[int], tries: int = 3) -> DataFrame:
    """(index, attempt, error) for each attempt at decoding one of ``indices`` that fails."""
    again = rows.where(F.col("index").isin(indices)).select("index", "bytes", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("attempt"))
    tried = again.withColumn("d", S.decode_audio("bytes"))
    return tried.where(~F.col("d.ok")).select("index", "attempt", F.col("d.error").alias("error"))


def load_clips(rows: DataFrame, rate: int = 32000, seconds: float = 5.0, seed: int | None = None, n_mels: int = 128, epoch: int = 0, limit: int | None = None, augmentations: list[Step] | None = None) -> DataFrame:
    """(index, label, ok, error, features) of (index, label, bytes): decoded, mixed, resampled, cropped, as 512 frames.

    A longer recording is cropped at the place that :func:`with_crop_starts` gives for ``seed`` + ``epoch``, or in the middle without a
    seed.  A recording that can't be decoded gets ``ok`` false and the error; a row that comes with an ``error`` (of its shard) keeps it.  ``limit``: only the first rows in the epoch's order
    of shards (needs ``shard``), counted before they are decoded.  ``augmentations``: steps that standardised features go through, drawn anew for
    each recording and epoch.
    """
    if limit is not None:
        rows = sent_rows(rows, seed or 0, epoch, limit)
    n = int(rate * seconds)

    def clip(data: bytes, index: int) -> np.ndarray:
        x, source, channels = S.decode(data)
        x = S.resample(x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), source, rate)
        spare = max(0, len(x) - n)
        start = spare // 2 if seed is None else crop_start_of(seed + epoch + index, index, spare)
        features = S.clip_features(x[start : start + n], rate, seconds, n_mels=n_mels)
        return apply_steps(features, augmentations, crop_start_of((seed or 0) + epoch + index, index, (1 << 62) - 1)) if augmentations else features

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 32):
                piece = part.iloc[at : at + 32]
                out = []
                for data, index, error in zip(piece["bytes"], piece["index"], piece["error"], strict=True):
                    if error is not None:
                        out.append((False, error, None))
                        continue
                    try:
                        out.append((True, None, clip(data, int(index)).ravel()))
                    except Exception as e:  # what a decoder raises on broken bytes is open
                        out.append((False, f"{type(e).__name__}: {e}", None))
                ok, error, features = zip(*out, strict=True)
                yield pd.DataFrame({"index": piece["index"], "label": piece["label"], "ok": ok, "error": error, "features": features})

    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string").alias("error")
    return rows.select("index", "label", "bytes", error).mapInPandas(run, "index bigint, label bigint, ok boolean, error string, features array<float>")


def load_shards(spark: SparkSession, uri: str, label: str = "label", split: str | None = None, subset: str | None = None, exclude: tuple[int, ...] = (), **how) -> tuple[DataFrame, Observation]:
    """:func:`load_clips` of the shards of a split, in which bad recordings and unreadable shards become rows with an error, and what was met.

    The observation has ``good``, ``bad_rows`` and ``bad_shards`` once an action on the rows has ended.
    """
    rows = read_shards(spark, uri, label, split, subset, exclude, bad="rows")
    rows = rows.select("index", "label", "shard", F.col("audio.bytes").alias("bytes"), "error")
    seen = Observation()
    out = load_clips(rows, **how)
    whole = F.col("index").isNotNull()  # an unreadable shard's row has none
    return out.observe(seen, F.count_if(F.col("ok")).alias("good"), F.count_if(~F.col("ok") & whole).alias("bad_rows"), F.count_if(~whole).alias("bad_shards")), seen
