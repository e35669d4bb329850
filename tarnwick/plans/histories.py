"""Training histories, with ``events`` as rows of five runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import rounded
from ..operators import timeseries as T
from .registry import query, table

HISTORY = """history AS (SELECT event_type AS run, event_id AS id, event_id % 700 AS step, epoch(ts) AS ts, value AS loss FROM events)"""
SEGMENTS = f"""WITH {HISTORY}, f AS (SELECT *, coalesce(step < lag(step) OVER (PARTITION BY run ORDER BY id), false) AS resumed FROM history),
segmented AS (SELECT *, CAST(sum(resumed::INT) OVER (PARTITION BY run ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f)"""


def history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D")
    return e.select(F.col("event_type").alias("run"), F.col("event_id").alias("id"), F.expr("event_id % 700").alias("step"), ts.alias("ts"), F.col("value").alias("loss"))


@query(SEGMENTS + " SELECT id, run, step, resumed, segment FROM segmented")
def segments(spark, sf_dir):
    return T.segments(history(spark, sf_dir), order="id").select("id", "run", "step", "resumed", "segment")


@query(SEGMENTS + " SELECT run, segment, min(step) AS step FROM segmented WHERE segment > 0 GROUP BY ALL")
def resume_steps(spark, sf_dir):
    return T.resume_steps(T.segments(history(spark, sf_dir), order="id"))


_LAGS = f"""WITH {HISTORY}, l AS (SELECT *, lag(step) OVER w AS step_before, lag(ts) OVER w AS ts_before, lag(loss) OVER w AS before FROM history
WINDOW w AS (PARTITION BY run ORDER BY ts, step))"""


@query(_LAGS + " SELECT run, step_before, step, round(before, 6) AS before, round(loss, 6) AS after, round(loss - before, 6) AS change FROM l WHERE step <= step_before AND ts - ts_before > 600")
def resume_transitions(spark, sf_dir):
    rows = T.transitions(history(spark, sf_dir), 600)
    return rows.withColumns({c: rounded(c, 6) for c in ("before", "after", "change")})


@query(f"""WITH {HISTORY}, l AS (SELECT run, step, step - lag(step) OVER w AS step_gap, loss - lag(loss) OVER w AS change FROM history WINDOW w AS (PARTITION BY run ORDER BY step, ts))
SELECT run, step, step_gap, round(change, 6) AS change FROM l WHERE step_gap > 100 OR abs(change) > 0.5""")
def anomalies(spark, sf_dir):
    return T.anomalies(history(spark, sf_dir), 100, 0.5).withColumn("change", rounded("change", 6))


def _ema_sql(keys: str, source: str) -> str:
    return f"""o AS (SELECT {keys}, id, loss, row_number() OVER (PARTITION BY {keys} ORDER BY step, ts) AS k FROM {source}),
    e AS (SELECT {keys}, id, k, loss AS ema FROM o WHERE k = 1 UNION ALL SELECT {', '.join('o.' + x.strip() for x in keys.split(','))}, o.id, o.k, 0.1::DOUBLE * o.loss + (1 - 0.1::DOUBLE) * e.ema
      FROM e JOIN o ON {' AND '.join(f'o.{x.strip()} = e.{x.strip()}' for x in keys.split(','))} AND o.k = e.k + 1)"""


@query(f"WITH RECURSIVE {HISTORY}, {_ema_sql('run', 'history')} SELECT run, id, round(ema, 6) AS ema FROM e")
def ema(spark, sf_dir):
    return T.ema(history(spark, sf_dir), 0.1).select("run", "id", rounded("ema", 6).alias("ema"))


@query(SEGMENTS.replace("WITH", "WITH RECURSIVE", 1) + f", {_ema_sql('run, segment', 'segmented')} SELECT run, segment, id, round(ema, 4) AS ema FROM e")
def ema_by_segment(spark, sf_dir):
    rows = T.segments(history(spark, sf_dir), order="id")
    return T.ema(rows, 0.1, keys=("run", "segment")).select("run", "segment", "id", rounded("ema", 4).alias("ema"))


_FRAME = "OVER (PARTITION BY run ORDER BY step, ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"


@query(f"WITH {HISTORY} SELECT run, id, round(quantile_cont(loss, 0.1) {_FRAME}, 6) AS low, round(quantile_cont(loss, 0.9) {_FRAME}, 6) AS high FROM history")
def rolling_quantile_band(spark, sf_dir):
    rows = T.rolling_quantiles(history(spark, sf_dir), 50, 0.1, 0.9)
    return rows.select("run", "id", rounded("low", 6).alias("low"), rounded("high", 6).alias("high"))


@query(f"WITH {HISTORY} SELECT run, id, round(stddev_pop(loss) {_FRAME}, 6) AS std FROM history")
def rolling_std(spark, sf_dir):
    return T.rolling_std(history(spark, sf_dir), 50).select("run", "id", rounded("std", 6).alias("std"))


@query(SEGMENTS.replace("WITH", "WITH RECURSIVE", 1).replace("ORDER BY id", "ORDER BY ts") + f""", {_ema_sql('run, segment', 'segmented')},
s AS (SELECT run, segment, id, stddev_pop(loss) OVER (PARTITION BY run, segment ORDER BY step, ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS std FROM segmented)
SELECT e.run, e.segment, e.id, round(ema - std, 5) AS lower, round(ema + std, 5) AS upper FROM e JOIN s USING (run, segment, id)""")
def ema_std_band(spark, sf_dir):
    return T.ema_band(history(spark, sf_dir), 0.1, 20).select("run", "segment", "id", rounded("lower", 5).alias("lower"), rounded("upper", 5).alias("upper"))


_AT = "marks AS (SELECT run, unnest([0, 100, 350, 699])::INT AS mark FROM (SELECT DISTINCT run FROM history))"


@query(f"""WITH {HISTORY}, {_AT}, x AS (SELECT a.run, a.mark AS "at", max(CASE WHEN step < mark THEN step END) AS step_before, min(CASE WHEN step >= mark THEN step END) AS step_after,
  arg_max(CASE WHEN step < mark THEN loss END, CASE WHEN step < mark THEN step * 1e11::DOUBLE + ts END) AS loss_before, arg_min(CASE WHEN step >= mark THEN loss END, CASE WHEN step >= mark THEN step * 1e11::DOUBLE + ts END) AS loss_after
  FROM history h JOIN marks a ON h.run = a.run GROUP BY ALL)
SELECT run, "at", step_before, step_after, round(loss_before, 6) AS loss_before, round(loss_after, 6) AS loss_after, round(loss_after - loss_before, 6) AS loss_delta
FROM x WHERE step_before IS NOT NULL AND step_after IS NOT NULL""")
def before_after(spark, sf_dir):
    rows = history(spark, sf_dir)
    at = rows.select("run").distinct().withColumn("at", F.explode(F.array(*map(F.lit, (0, 100, 350, 699)))))
    out = T.before_after(rows, at)
    return out.withColumns({c: rounded(c, 6) for c in ("loss_before", "loss_after", "loss_delta")})


@query(f"""WITH {HISTORY} SELECT DISTINCT step, round(CASE WHEN step < 100 THEN 0.001::DOUBLE * step / 100.0 WHEN step < 500 THEN 0.001::DOUBLE
  ELSE greatest(0.001::DOUBLE * (1 - (step - 500) / 200.0), 0) END, 9) AS rate FROM history""")
def wsd_lr(spark, sf_dir):
    return history(spark, sf_dir).select("step").distinct().select("step", rounded(T.wsd_rate(F.col("step"), 0.001, 100, 400, 200), 9).alias("rate"))


@query(f"""WITH {HISTORY} SELECT DISTINCT step, round(CASE WHEN step < 100 THEN 0.001::DOUBLE * step / 100.0 ELSE 0.001::DOUBLE * 0.5 * (1 + cos(pi() * least((step - 100) / 600.0, 1.0))) END, 9) AS rate FROM history""")
def cosine_lr(spark, sf_dir):
    return history(spark, sf_dir).select("step").distinct().select("step", rounded(T.cosine_rate(F.col("step"), 0.001, 100, 700), 9).alias("rate"))


_BOTH = f"""{HISTORY.replace('value AS loss', "value AS loss, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value / 2 END AS entropy")}"""


@query(f"""WITH {_BOTH}, h AS (SELECT *, nullif(entropy, 0) AS e FROM history), l AS (SELECT *, lag(step) OVER w AS step_before, lag(ts) OVER w AS ts_before, lag(loss) OVER w AS lb, lag(e) OVER w AS eb FROM h
WINDOW w AS (PARTITION BY run ORDER BY ts, step))
SELECT run, step_before, step, round(lb, 6) AS loss_before, round(loss, 6) AS loss_after, round(loss - lb, 6) AS loss_change, round(eb, 6) AS entropy_before, round(e, 6) AS entropy_after, round(e - eb, 6) AS entropy_change
FROM l WHERE step <= step_before AND ts - ts_before > 60""")
def strict_transitions(spark, sf_dir):
    rows = history(spark, sf_dir).withColumn("entropy", F.when(F.col("id") % 4 == 0, F.lit(0.0)).otherwise(F.col("loss") / 2))
    out = T.strict_transitions(rows, 60, ("loss", "entropy"), zero_is_missing=("entropy",))
    return out.withColumns({c: rounded(c, 6) for c in out.columns if c.endswith(("before", "after", "change")) and c != "step_before"})


@query(f"""WITH RECURSIVE {HISTORY}, {_AT}, {_ema_sql('run', 'history')}, s AS (SELECT h.run, h.step, h.ts, e.ema FROM history h JOIN e USING (run, id)),
x AS (SELECT a.run, a.mark AS "at", max(CASE WHEN step < mark THEN step END) AS step_before, min(CASE WHEN step >= mark THEN step END) AS step_after,
  arg_max(CASE WHEN step < mark THEN ema END, CASE WHEN step < mark THEN step * 1e11::DOUBLE + ts END) AS b, arg_min(CASE WHEN step >= mark THEN ema END, CASE WHEN step >= mark THEN step * 1e11::DOUBLE + ts END) AS f
  FROM s JOIN marks a ON s.run = a.run GROUP BY ALL)
SELECT run, "at", round(b, 6) AS ema_before, round(f, 6) AS ema_after, round(f - b, 6) AS ema_delta FROM x WHERE step_before IS NOT NULL AND step_after IS NOT NULL""")
def smoothed_deltas(spark, sf_dir):
    rows = history(spark, sf_dir)
    at = rows.select("run").distinct().withColumn("at", F.explode(F.array(*map(F.lit, (0, 100, 350, 699)))))
    out = T.smoothed_deltas(rows, at, 0.1)
    return out.select("run", "at", *(rounded(c, 6).alias(c) for c in ("ema_before", "ema_after", "ema_delta")))
