"""Training histories: segments after restarts, anomalies, smoothing, bands, values before and after a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import written
from . import ordered

#: Rows of a run that one task smooths or rolls over.
BLOCK = 1 << 18


def segments(history: DataFrame, run: str = "run", order: str = "ts", step: str = "step") -> DataFrame:
    """``history`` plus ``resumed`` (its step is below the one before) and ``segment`` (how many such so far)."""
    w = Window.partitionBy(run).orderBy(order)
    back = F.coalesce(F.col(step) < F.lag(step).over(w), F.lit(False))
    return history.withColumn("resumed", back).withColumn("segment", F.sum(F.col("resumed").cast("int")).over(w))


def resume_steps(segmented: DataFrame) -> DataFrame:
    """(run, segment, step): where each segment but the first starts."""
    return segmented.where("segment > 0").groupBy("run", "segment").agg(F.min("step").alias("step"))


def transitions(history: DataFrame, pause: float, value: str = "loss") -> DataFrame:
    """Rows at which a step does not go on after a pause of more than ``pause`` seconds, with the values around."""
    w = Window.partitionBy("run").orderBy("ts", "step")
    rows = history.withColumns({"step_before": F.lag("step").over(w), "ts_before": F.lag("ts").over(w), "before": F.lag(value).over(w)})
    rows = rows.where((F.col("step") <= F.col("step_before")) & (F.col("ts") - F.col("ts_before") > pause))
    return rows.select("run", "step_before", "step", "before", F.col(value).alias("after"), (F.col(value) - F.col("before")).alias("change"))


def strict_transitions(history: DataFrame, pause: float, values: tuple[str, ...], zero_is_missing: tuple[str, ...] = ()) -> DataFrame:
    """What :func:`transitions` gives for several values; a 0 of a value in ``zero_is_missing`` counts as none."""
    for v in zero_is_missing:
        history = history.withColumn(v, F.nullif(F.col(v), F.lit(0.0)))
    w = Window.partitionBy("run").orderBy("ts", "step")
    rows = history.withColumns({"step_before": F.lag("step").over(w), "ts_before": F.lag("ts").over(w), **{f"{v}_before": F.lag(v).over(w) for v in values}})
    rows = rows.where((F.col("step") <= F.col("step_before")) & (F.col("ts") - F.col("ts_before") > pause))
    each = [c for v in values for c in (F.col(f"{v}_before"), F.col(v).alias(f"{v}_after"), (F.col(v) - F.col(f"{v}_before")).alias(f"{v}_change"))]
    return rows.select("run", "step_before", "step", *each)


def smoothed_deltas(history: DataFrame, at: DataFrame, alpha: float, value: str = "loss") -> DataFrame:
    """:func:`before_after` of a value and of its smoothed course."""
    rows = ema(history, alpha, value=value)
    return before_after(rows, at, (value, "ema"))


def anomalies(history: DataFrame, gap: int, jump: float, value: str = "loss") -> DataFrame:
    """Rows whose step is more than ``gap`` after the one before, or whose value differs by more than ``jump``."""
    w = Window.partitionBy("run").orderBy("step", "ts")
    rows = history.withColumns({"step_gap": F.col("step") - F.lag("step").over(w), "change": F.col(value) - F.lag(value).over(w)})
    return rows.where((F.col("step_gap") > gap) | (F.abs("change") > jump)).select("run", "step", "step_gap", "change")


def _smoothed(values: np.ndarray, first: np.ndarray, alpha: float, last: float) -> np.ndarray:
    """The recurrence from ``last`` on, from 0 on anew where ``first`` is true."""
    out = []
    for v, new in zip(values.tolist(), first.tolist(), strict=True):
        last = alpha * v + (1 - alpha) * (0.0 if new else last)
        out.append(last)
    return np.array(out, float)


def _schema(rows: DataFrame, more: str, drop: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in drop), more])


def ema(history: DataFrame, alpha: float, keys: tuple[str, ...] = ("run",), order: tuple[str, ...] = ("step", "ts"), value: str = "loss", block: int = BLOCK) -> DataFrame:
    """``history`` plus ``ema``: e0 = v0, then alpha * v + (1 - alpha) * e before it.

    The recurrence is linear, so blocks of ``block`` rows of a run are smoothed on their own, and what a block starts from is
    carried on from the ends of those before it, one row a block: no task holds a whole run.
    """
    rows = ordered.blocks(history, order, keys, block)

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for part in parts:
            if len(part):
                out = _smoothed(part[value].to_numpy(float), part[ordered.AT].to_numpy() % block == 0, alpha, last)
                last = float(out[-1])
                yield part.assign(__own=out)

    dealt = rows.repartition(*keys, ordered.BLOCK).sortWithinPartitions(*keys, ordered.BLOCK, ordered.AT)
    smoothed = written(dealt.mapInPandas(own, _schema(rows, "__own double")), "smoothed")
    ends = smoothed.groupBy(*keys, ordered.BLOCK).agg(
        F.max_by("__own", ordered.AT).alias("end"), F.count("*").alias("size"), F.min_by(value, ordered.AT).cast("double").alias("first")
    )

    def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = 0.0
        for part in parts:
            carry = []
            for block_no, end, size, first in zip(*(part[c].tolist() for c in (ordered.BLOCK, "end", "size", "first")), strict=True):
                now = first if block_no == 0 else now  # the first block of a run
                carry.append(now)
                now = end + (1 - alpha) ** size * now
            yield part.assign(carry=carry).drop(columns=["end", "size", "first"])

    # a stream over sorted partitions: many short runs need no group each
    sorted_ends = ends.repartition(*keys).sortWithinPartitions(*keys, ordered.BLOCK)
    carried = sorted_ends.mapInPandas(chain, _schema(ends, "carry double", ("end", "size", "first")))
    both = ordered.joined(smoothed, carried, (*keys, ordered.BLOCK))
    power = F.pow(F.lit(1 - alpha), F.col(ordered.AT) % block + 1)
    return both.withColumn("ema", F.col("__own") + power * F.col("carry")).drop(ordered.AT, ordered.BLOCK, ordered.HOME, "__own", "carry")


class _Frames(BaseIndexer):
    """Frames from ``starts`` up to and with each row."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.starts.astype(np.int64), np.arange(1, num_values + 1)


def _rolled(history: DataFrame, width: int, keys: tuple[str, ...], order: tuple[str, ...], value: str, block: int, columns: dict) -> DataFrame:
    """``history`` plus ``columns``, functions of a frame of the last ``width`` values: each block of a run also gets the rows before it that its frames reach."""
    size = max(block, width)
    rows = ordered.blocks(history, order, keys, size, width - 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0)  # the values that the next frames reach, and how many rows of their block they begin with
        into = 0
        for part in parts:
            if not len(part):
                continue
            at, of = part[ordered.AT].to_numpy(), part[ordered.BLOCK].to_numpy()
            new = at == np.maximum(of * size - (width - 1), 0)  # a block's first row
            place = np.arange(len(part))
            begin = np.maximum.accumulate(np.where(new, place, -into))  # where a row's block begins, before this part as a negative place
            start = np.maximum(begin, place - width + 1) + len(held)
            frames = pd.Series(np.concatenate([held, part[value].to_numpy(float)])).rolling(_Frames(starts=np.concatenate([np.zeros(len(held), np.int64), start])), min_periods=1)
            found = {name: f(frames).to_numpy()[len(held) :] for name, f in columns.items()}
            into = int(place[-1] + 1 - begin[-1])
            keep = min(into, width - 1)
            held = np.concatenate([held, part[value].to_numpy(float)])[-keep:] if keep else np.zeros(0)
            into = keep
            yield part.assign(**found)[(part[ordered.HOME] == of).to_numpy()].drop(columns=[ordered.AT, ordered.HOME, ordered.BLOCK])

    drop = (ordered.AT, ordered.HOME, ordered.BLOCK)
    dealt = rows.repartition(*keys, ordered.BLOCK).sortWithinPartitions(*keys, ordered.BLOCK, ordered.AT)
    out = dealt.mapInPandas(run, _schema(rows, ", ".join(f"{c} double" for c in columns), drop))
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in columns})


def rolling_quantiles(history: DataFrame, width: int, low: float, high: float, keys=("run",), order=("step", "ts"), value: str = "loss", block: int = BLOCK) -> DataFrame:
    """``history`` plus ``low`` and ``high``: interpolated quantiles of the last ``width`` values, nulls and NaN left out.

    A frame is an ordered list into which one value goes and from which one leaves for each row.
    """
    return _rolled(history, width, keys, order, value, block, {"low": lambda f: f.quantile(low), "high": lambda f: f.quantile(high)})


def rolling_std(history: DataFrame, width: int, keys=("run",), order=("step", "ts"), value: str = "loss", block: int = BLOCK) -> DataFrame:
    """``history`` plus ``std``: population deviation of the last ``width`` values, nulls and NaN left out."""
    return _rolled(history, width, keys, order, value, block, {"std": lambda f: f.std(ddof=0)})


def ema_band(history: DataFrame, alpha: float, width: int, value: str = "loss") -> DataFrame:
    """Smoothed value with a band of one rolling deviation, within each segment of each run; nulls are left out."""
    rows = segments(history).where(F.col(value).isNotNull())
    keys = ("run", "segment")
    rows = rolling_std(ema(rows, alpha, keys, value=value), width, keys, value=value)
    return rows.withColumns({"lower": F.col("ema") - F.col("std"), "upper": F.col("ema") + F.col("std")})


def before_after(history: DataFrame, at: DataFrame, columns: tuple[str, ...] = ("loss",)) -> DataFrame:
    """For each (run, at): values of the last row before step ``at`` and of the first from it on; both must exist."""
    rows = history.join(at, "run")
    early, late = F.col("step") < F.col("at"), F.col("step") >= F.col("at")
    first = lambda c: F.min_by(F.when(late, F.col(c)), F.when(late, F.struct("step", "ts")))
    last = lambda c: F.max_by(F.when(early, F.col(c)), F.when(early, F.struct("step", "ts")))
    out = rows.groupBy("run", "at").agg(
        F.max(F.when(early, F.col("step"))).alias("step_before"), F.min(F.when(late, F.col("step"))).alias("step_after"),
        *(last(c).alias(f"{c}_before") for c in columns), *(first(c).alias(f"{c}_after") for c in columns),
    ).where("step_before is not null and step_after is not null")
    return out.withColumns({f"{c}_delta": F.col(f"{c}_after") - F.col(f"{c}_before") for c in columns})


def wsd_rate(step: Column, peak: float, warmup: int, stable: int, decay: int) -> Column:
    """Learning rate that rises linearly, stays, and falls linearly to 0."""
    fall = peak * (1 - (step - warmup - stable) / float(decay))
    return F.when(step < warmup, peak * step / float(warmup)).when(step < warmup + stable, F.lit(peak)).otherwise(F.greatest(fall, F.lit(0.0)))


def cosine_rate(step: Column, peak: float, warmup: int, total: int, end: float = 0.0) -> Column:
    """Learning rate that rises linearly and falls along a half cosine from ``peak`` to ``end``."""
    share = F.least((step - warmup) / float(max(1, total - warmup)), F.lit(1.0))
    return F.when(step < warmup, peak * step / float(warmup)).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(F.lit(np.pi) * share)))
