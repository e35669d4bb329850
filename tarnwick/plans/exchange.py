"""What is written and read back: shards, recordings, logs, histories, results, checkpoints; all rows derive from the given tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signal as S
from ..functions.arrays import rounded
from ..operators import loader, relational, sampling, sinks
from ..scratch import folder
from ..sources import logs, shards
from ..sources.shard_sink import write_shards
from ..streaming import stateful
from .registry import query, table

# -- shards --------------------------------------------------------------------------------------


def event_rows(spark, sf_dir):
    """Events as recordings: the properties are the bytes, the user the class, null for every eleventh event."""
    e = table(spark, sf_dir, "events")
    audio = F.struct(F.encode("props", "utf-8").alias("bytes"), F.col("event_type").alias("path"))
    label = F.when(F.col("event_id") % 11 != 0, F.col("user_id"))
    split = F.when(F.col("event_id") % 5 == 0, "test").otherwise("train")
    return e.select("event_id", audio.alias("audio"), label.alias("label"), split.alias("split"), F.col("event_type").alias("subset"))


def in_order(rows, key):
    """``rows`` in ranges of ``key``, a task each, so that shards in order of path are in order of ``key``."""
    return rows.repartitionByRange(8, key).sortWithinPartitions(key)


_RECORDS = """r AS (SELECT event_id, props AS bytes, event_type AS name, CASE WHEN event_id % 11 <> 0 THEN user_id END AS label, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, event_type AS subset FROM events)"""


@query(f"""WITH {_RECORDS}, i AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS "index" FROM r WHERE split = 'train')
SELECT CAST("index" AS BIGINT) AS "index", label, bytes, name FROM i WHERE "index" NOT IN (0, 17, 399, 400)""")
def shards_of_split(spark, sf_dir):
    """The training split by ``index``, its place over all shards, without four indices."""
    uri = folder(spark, "shards")
    write_shards(in_order(event_rows(spark, sf_dir).drop("subset"), "event_id"), uri, shard_rows=300)
    rows = shards.read_shards(spark, uri, split="train", exclude=(0, 17, 399, 400))
    return rows.select("index", "label", F.decode("audio.bytes", "utf-8").alias("bytes"), F.col("audio.path").alias("name"))


@query(f"WITH {_RECORDS} SELECT subset, split, count(*) AS n, count(label) AS n_labels, CAST(sum(strlen(bytes)) AS BIGINT) AS n_bytes FROM r GROUP BY ALL")
def shard_sizes(spark, sf_dir):
    uri = folder(spark, "shards")
    write_shards(event_rows(spark, sf_dir), uri, shard_rows=300)
    rows = shards.read_shards(spark, uri)
    return rows.groupBy("subset", "split").agg(F.count("*").alias("n"), F.count("label").alias("n_labels"), F.sum(F.octet_length("audio.bytes")).alias("n_bytes"))


@query(f"WITH {_RECORDS} SELECT label, bytes, subset, split, count(*) AS n FROM r GROUP BY ALL")
def shard_stream(spark, sf_dir):
    """Shards read as a stream in two runs, the second from the first one's checkpoint, with new shards before it."""
    path, rows = folder(spark, "streams"), event_rows(spark, sf_dir)
    for part in (0, 1):
        write_shards(rows.where(F.col("event_id") % 2 == part), f"{path}/in", shard_rows=300)
        out = stateful.run_available(shards.stream_shards(spark, f"{path}/in"), path)
    return out.groupBy("label", F.decode("audio.bytes", "utf-8").alias("bytes"), "subset", "split").agg(F.count("*").alias("n"))


# -- recordings ----------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def wav_of(values: pd.Series, ids: pd.Series) -> pd.Series:
    """Vectors as stereo WAV files of 1, 2 or 4 bytes, or floating-point ones, in turn."""
    kinds = ((1, False), (2, False), (4, False), (4, True))
    return pd.Series([S.encode_wav(x, 8000, 2, *kinds[i % 4]) for x, i in zip(values, ids, strict=True)])


_FULL = "CASE vec_id % 4 WHEN 0 THEN 128 WHEN 1 THEN 32768 ELSE 2147483648 END"


@query(f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
w AS (SELECT vec_id, i, CASE WHEN vec_id % 4 = 3 THEN x ELSE greatest(-{_FULL}, least({_FULL} - 1, floor(x * {_FULL})))::DOUBLE / {_FULL} END AS x FROM v),
m AS (SELECT vec_id, (i - 1) // 2 AS k, avg(CAST(CAST(x AS FLOAT) AS DOUBLE)) AS x FROM w GROUP BY ALL)
SELECT vec_id, 8000 AS rate, 2 AS channels, list(CAST(x AS FLOAT) ORDER BY k) AS mono FROM m GROUP BY vec_id""")
def decoded_waves(spark, sf_dir):
    """Samples of WAV files in four formats, mixed to one channel."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", S.decode_audio(wav_of("embedding", "vec_id")).alias("d"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: ((F.col("d.samples")[2 * k].cast("double") + F.col("d.samples")[2 * k + 1]) / 2).cast("float"))
    return d.select("vec_id", "d.rate", "d.channels", pairs.alias("mono"))


def broken_rows(spark, sf_dir):
    """Vectors as recordings, every seventh of them broken."""
    e = table(spark, sf_dir, "embeddings")
    data = F.when(F.col("vec_id") % 7 == 0, F.encode(F.concat(F.lit("broken "), F.col("vec_id")), "utf-8")).otherwise(wav_of("embedding", "vec_id"))
    return e.select("vec_id", F.struct(data.alias("bytes"), F.lit("v").alias("path")).alias("audio"), F.col("vec_id").alias("label"))


@query("""SELECT label, ok, error, n_values, CAST(count(*) OVER (PARTITION BY ok) AS BIGINT) AS counted FROM (SELECT vec_id AS label, vec_id % 7 <> 0 AS ok,
  CASE WHEN vec_id % 7 = 0 THEN 'ValueError: no decoder for ''brok''' END AS error, CASE WHEN vec_id % 7 <> 0 THEN 512 * 16 END AS n_values FROM embeddings)""")
def loaded_shards(spark, sf_dir):
    """Every recording of the shards as a clip or as an error; ``counted``: what the loader counted of its kind."""
    uri = folder(spark, "shards")
    write_shards(broken_rows(spark, sf_dir), uri, shard_rows=200)
    clips, seen = loader.load_shards(spark, uri, rate=8000, seconds=0.1, n_mels=16)
    path = folder(spark, "clips")
    clips.select("label", "ok", "error", F.size("features").alias("n_values")).write.parquet(path)
    counted = F.when(F.col("ok"), F.lit(seen.get["good"])).otherwise(F.lit(seen.get["bad_rows"]))
    rows = spark.read.parquet(path)
    return rows.select("label", "ok", "error", F.when(F.col("ok"), F.col("n_values")).alias("n_values"), counted.cast("bigint").alias("counted"))


@query("""SELECT vec_id AS "index", attempt, 'ValueError: no decoder for ''brok''' AS error FROM embeddings, (SELECT unnest([1, 2, 3])::INT AS attempt) WHERE vec_id % 7 = 0 AND vec_id < 70""")
def failed_attempts(spark, sf_dir):
    """Which attempts at decoding the first seventy recordings fail."""
    rows = broken_rows(spark, sf_dir).select(F.col("vec_id").alias("index"), F.col("audio.bytes").alias("bytes"))
    return loader.check_indices(rows, list(range(70)), tries=3)


# -- log-mel values ------------------------------------------------------------------------------

_TINY = f"{float(np.finfo(np.float32).eps)!r}::DOUBLE"
_MEL = "1127.0::DOUBLE * ln(1 + {f} / 700.0::DOUBLE)"


def _mel_frames(source: str, frames: int) -> str:
    """SQL tables that end in ``mel`` (vec_id, t, b, x) and ``loud`` (vec_id, t, x), of ``source`` (vec_id, i, x): 16 samples every 8, four bands of 20 to 500 Hz at 1000 Hz."""
    return f"""f AS (SELECT vec_id, t, i - 8 * t AS j, x FROM {source} JOIN (SELECT unnest(range({frames})) AS t) ON i BETWEEN 8 * t AND 8 * t + 15),
m AS (SELECT vec_id, t, j, x - avg(x) OVER (PARTITION BY vec_id, t) AS x FROM f), loud AS (SELECT vec_id, t, ln(greatest(sum(x * x), {_TINY})) AS x FROM m GROUP BY ALL),
p AS (SELECT vec_id, t, j, (x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY vec_id, t ORDER BY j), x)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 15)) AS x FROM m),
d AS (SELECT vec_id, t, k, power(sum(x * cos(2 * pi() * k * j / 16)), 2) + power(sum(x * sin(2 * pi() * k * j / 16)), 2) AS x FROM p, (SELECT unnest(range(8)) AS k) GROUP BY ALL),
e AS (SELECT {_MEL.format(f='20.0::DOUBLE')} AS low, {_MEL.format(f='500.0::DOUBLE')} AS high),
w AS (SELECT b, k, greatest(0, least((y - low - s * b) / s, (low + s * (b + 2) - y) / s)) AS w FROM (SELECT low, (high - low) / 5 AS s, b, k, {_MEL.format(f='(k * 62.5::DOUBLE)')} AS y FROM e, (SELECT unnest(range(4)) AS b), (SELECT unnest(range(8)) AS k))),
mel AS (SELECT vec_id, t, b, ln(greatest(sum(x * w), {_TINY})) AS x FROM d JOIN w USING (k) GROUP BY ALL)"""


_SAMPLES = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_SHORT = dict(window_ms=16, hop_ms=8, n_mels=4)


@query(f"""WITH {_SAMPLES}, {_mel_frames('v', 7)}, a AS (SELECT vec_id, t, b, x FROM mel UNION ALL SELECT vec_id, t, -1, x FROM loud),
one AS (SELECT vec_id, list(round(CAST(x AS FLOAT)::DOUBLE, 4) ORDER BY t, b) AS by_frame FROM a GROUP BY vec_id), two AS (SELECT vec_id, list(round(CAST(x AS FLOAT)::DOUBLE, 4) ORDER BY b, t) AS by_band FROM mel GROUP BY vec_id)
SELECT vec_id, by_frame, by_band FROM one JOIN two USING (vec_id)""")
def log_mel_values(spark, sf_dir):
    """Log-mel energies by frame, with the frame's energy before them, and by band: against a direct Fourier sum."""
    by_frame = S.array_udf(lambda x: S.log_mel(x, 1000, energy=True, **_SHORT))
    by_band = S.array_udf(lambda x: S.mel_by_frame(x, 1000, **_SHORT))
    digits = lambda c: F.transform(c, lambda x: rounded(x.cast("double"), 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", digits(by_frame("embedding")).alias("by_frame"), digits(by_band("embedding")).alias("by_band"))


@query(f"""WITH {_SAMPLES}, z AS (SELECT vec_id, i, x FROM v UNION ALL SELECT vec_id, i, 0 FROM (SELECT vec_id FROM embeddings), (SELECT unnest(range(64, 80)) AS i)), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM z),
{_mel_frames('c', 9)}, g AS (SELECT vec_id, t, b, CAST(x AS FLOAT) AS x FROM mel), least_one AS (SELECT vec_id, min(x) AS low FROM g GROUP BY vec_id)
SELECT vec_id, 512 * 4 AS n, list(round(CAST((x - CAST(-7.2 AS FLOAT)) / CAST(8.86 AS FLOAT) AS DOUBLE), 4) ORDER BY t, b) AS head, round(CAST((any_value(low) - CAST(-7.2 AS FLOAT)) / CAST(8.86 AS FLOAT) AS DOUBLE), 4) AS filled, true AS all_filled
FROM g JOIN least_one USING (vec_id) GROUP BY vec_id""")
def clip_values(spark, sf_dir):
    """Standardised features of a clip of 80 samples: nine frames, then 503 of the clip's least value."""
    features = S.array_udf(lambda x: S.clip_features(x, 1000, 0.08, **_SHORT))
    x = table(spark, sf_dir, "embeddings").select("vec_id", features("embedding").alias("f"))
    digits = lambda c: rounded(c.cast("double"), 4)
    rest = F.slice("f", 37, 512 * 4 - 36)
    return x.select("vec_id", F.size("f").alias("n"), F.transform(F.slice("f", 1, 36), digits).alias("head"), digits(F.element_at("f", -1)).alias("filled"), ((F.array_min(rest) == F.array_max(rest)) & (F.array_max(rest) == F.array_min("f"))).alias("all_filled"))


_GRID = S.PatchGrid(samples=64, rate=1000, n_fft=16, hop=4, window=12, times=4, bands=4, frames=4)
_ANGLE = "2 * pi() * k * n / 16"


@query(f"""WITH {_SAMPLES}, h AS (SELECT n, CASE WHEN n BETWEEN 2 AND 13 THEN 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (n - 2) / 12) ELSE 0 END AS w FROM (SELECT unnest(range(16)) AS n)), t AS (SELECT unnest(range(17)) AS t),
g AS (SELECT t, n, w, CASE WHEN q < 0 THEN -q WHEN q > 63 THEN 126 - q ELSE q END AS i FROM (SELECT *, 4 * t + n - 8 AS q FROM h, t)),
s AS (SELECT vec_id, t, k, sum(x * w * cos({_ANGLE})) AS re, -sum(x * w * sin({_ANGLE})) AS im FROM v JOIN g USING (i), (SELECT unnest(range(9)) AS k) GROUP BY ALL),
c AS (SELECT 2595 * log10(1 + 20.0::DOUBLE / 700) AS low, 2595 * log10(1 + 500.0::DOUBLE / 700) AS high), e AS (SELECT j, 700 * (power(10.0::DOUBLE, (low + (high - low) * j / 4) / 2595) - 1) AS hz FROM c, (SELECT unnest(range(5)) AS j)),
b AS (SELECT k, max(j) AS band FROM (SELECT unnest(range(9)) AS k), e WHERE hz <= k * 62.5::DOUBLE GROUP BY k HAVING max(j) < 4),
m AS (SELECT vec_id, t, k, re, im FROM s JOIN b USING (k) WHERE t < 16 AND (vec_id + t // 4 * 4 + band) % 7 = 0),
y AS (SELECT vec_id, t, n, sum(CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END * (re * cos({_ANGLE}) - im * sin({_ANGLE}))) / 16 * any_value(w) AS y FROM m, h GROUP BY ALL),
o AS (SELECT vec_id, 4 * t + n - 8 AS i, sum(y) AS y FROM y GROUP BY ALL), d AS (SELECT 4 * t + n - 8 AS i, sum(w * w) AS d FROM h, t GROUP BY ALL),
p AS (SELECT vec_id, i, coalesce(y, 0) / d AS x FROM v JOIN d USING (i) LEFT JOIN o USING (vec_id, i) WHERE (vec_id + i // 16 * 4) % 7 IN (0, 4, 5, 6))
SELECT vec_id, list(round(CAST(x AS FLOAT)::DOUBLE, 5) + 0.0 ORDER BY i) AS kept FROM p GROUP BY vec_id""")
def filtered_bands(spark, sf_dir):
    """Times and mel bands of a vector's active patches: against direct Fourier sums, forward and back."""
    active = F.array(*((F.col("vec_id") + p) % 7 == 0 for p in range(16)))
    kept = S.array_udf(lambda x, on: S.filter_audio(x, on, True, _GRID))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(kept("embedding", active), lambda x: rounded(x.cast("double"), 5) + F.lit(0.0)).alias("kept"))


# -- logs, histories, summaries ------------------------------------------------------------------


@query("SELECT event_id AS step, round(value, 4) AS value FROM events WHERE event_type = 'click'")
def log_lines(spark, sf_dir):
    """Steps and values of the lines of a text log that match."""
    path, e = folder(spark, "logs"), table(spark, sf_dir, "events")
    hit = F.format_string("[info] step=%d param_norm=%.4f", "event_id", "value")
    e.select(F.when(F.col("event_type") == "click", hit).otherwise(F.concat(F.lit("[info] user "), "user_id", F.lit(" step=none param_norm=")))).write.text(path)
    return logs.log_values(spark, path, r"step=(\d+) param_norm=([-\d.]+)").select("step", "value")


_LOGGED = """l AS (SELECT event_type AS run_id, user_id AS seed, CASE WHEN event_id % 3 > 0 THEN event_id END AS step, CASE WHEN event_id % 4 > 0 THEN event_id + 1 END AS _step,
CASE WHEN event_id % 5 > 0 THEN value END AS loss, CASE WHEN event_id % 7 > 0 THEN value / 4 END AS entropy FROM events)"""


def logged(spark, sf_dir):
    part = lambda n, c: F.when(F.col("event_id") % n > 0, c)
    step, other = part(3, F.col("event_id")), part(4, F.col("event_id") + 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"), F.col("user_id").alias("seed"), step.alias("step"), other.alias("_step"), part(5, F.col("value")).alias("loss"), part(7, F.col("value") / 4).alias("entropy")
    )


_KNOWN = "SELECT run_id, seed, coalesce(step, _step) AS step, loss, entropy FROM l WHERE coalesce(step, _step) IS NOT NULL AND (loss IS NOT NULL OR entropy IS NOT NULL)"


@query(f"WITH {_LOGGED} {_KNOWN}")
def metric_history(spark, sf_dir):
    """Metrics that were logged, nulls left out, read as histories with a step and a metric."""
    path = folder(spark, "logs")
    sinks.log_metrics(logged(spark, sf_dir), path)
    return logs.history(spark, path).select("run_id", "seed", "step", "loss", "entropy")


@query(f"WITH {_LOGGED} {_KNOWN}")
def history_of_summaries(spark, sf_dir):
    """The same where the wanted names stand under a summary only, so that all columns are gone through."""
    path, rows = folder(spark, "logs"), logged(spark, sf_dir)
    rows.select("run_id", "seed", F.struct("step", "_step", "loss", "entropy").alias("summary")).write.json(path)
    return logs.history(spark, path).select("run_id", "seed", "step", "loss", "entropy")


@query("""SELECT o_orderkey AS run, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'adam' END AS optimizer, o_totalprice AS loss, o_custkey / 1000.0::DOUBLE AS lr FROM orders WHERE o_orderkey % 5 > 0 AND o_custkey % 6 > 0""")
def run_summaries(spark, sf_dir):
    """Summaries of runs: a missing optimizer is the default one, those without a loss or rate are left out."""
    path, o = folder(spark, "logs"), table(spark, sf_dir, "orders")
    part = lambda key, n, c: F.when(F.col(key) % n > 0, c)
    rows = o.select(F.col("o_orderkey").alias("run"), part("o_orderkey", 3, F.col("o_orderpriority")).alias("optimizer"), part("o_orderkey", 5, F.col("o_totalprice")).alias("loss"), part("o_custkey", 6, F.col("o_custkey") / 1000).alias("lr"))
    rows.write.json(path)
    return logs.summaries(spark, path, "run bigint, optimizer string, loss double, lr double")


# -- results -------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderstatus AS clf, count(*) AS n, round(avg(o_totalprice), 4) AS cmap, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL
UNION ALL SELECT 'C', count(DISTINCT c_nationkey), round(avg(c_acctbal), 4), min(c_nationkey), max(c_nationkey) FROM customer), k AS (SELECT *, n < 1000 AS held FROM o)
SELECT clf, cmap, CASE WHEN held THEN CAST(n AS INT) END AS listed, CASE WHEN held THEN printf('%09d', first) END AS first, CASE WHEN held THEN printf('%09d', last) END AS last, CASE WHEN clf = 'P' THEN 'more' END AS note, true AS traced, true AS ran, false AS ran_otherwise FROM k""")
def results_written(spark, sf_dir):
    """A result for each order status and one of customers by nation, with their predictions where they are few, under differing schemas; read back and looked up by key."""
    path, o, c = folder(spark, "results"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    made = lambda rows, key, n, score: rows.select(F.format_string("%09d", key).alias("example_id"), F.array(n).alias("y_true"), F.array(n).alias("y_pred"), F.array(score).alias("y_score"))
    for status in ("F", "O", "P"):
        of = o.where(F.col("o_orderstatus") == status)
        result = of.groupBy(F.col("o_orderstatus").alias("clf")).agg(F.round(F.avg("o_totalprice"), 4).alias("cmap"))
        more = result.withColumn("note", F.lit("more")) if status == "P" else result
        sinks.write_result(more, made(of, "o_orderkey", F.col("o_custkey").cast("int"), "o_totalprice"), path, most=1000)
    nations = c.groupBy("c_nationkey").agg(F.count("*").cast("int").alias("n"), F.avg("c_acctbal").alias("score"))
    sinks.write_result(c.agg(F.lit("C").alias("clf"), F.round(F.avg("c_acctbal"), 4).alias("cmap")), made(nations, "c_nationkey", "n", "score"), path, most=1000)
    rows = sinks.read_results(spark, path)
    ids = F.col("pred_example_ids")
    ran, other = sinks.already_ran(spark, path, {"clf": "P", "note": "more"}), sinks.already_ran(spark, path, {"clf": "F", "note": "more"})
    traced = F.col("argv").isNotNull() & F.col("git_commit").isNotNull() & (F.col("posix") > 0) & (F.col("hostname") != "")
    return rows.select(
        "clf", "cmap", F.when(ids.isNotNull(), F.size(ids)).alias("listed"), F.element_at(ids, 1).alias("first"), F.element_at(ids, -1).alias("last"), "note",
        traced.alias("traced"), F.lit(ran).alias("ran"), F.lit(other).alias("ran_otherwise"),
    )


@query("SELECT event_id AS \"index\", props AS error FROM events WHERE event_type = 'error'")
def error_lines(spark, sf_dir):
    path, e = folder(spark, "errors"), table(spark, sf_dir, "events")
    sinks.write_errors(e.select(F.col("event_id").alias("index"), F.col("props").alias("error"), (F.col("event_type") != "error").alias("ok")), path)
    return spark.read.schema("index bigint, error string").json(path)


@query("""SELECT user_id, n, round(total, 4) AS total, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS line FROM (SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id)""")
def csv_report(spark, sf_dir):
    """A sorted report as one CSV file, read back with the numbers of its lines."""
    path = folder(spark, "csv")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("unused"))
    sinks.write_csv(rows, path, ("user_id",), ("user_id", "n", "total"))
    back = spark.read.schema("user_id bigint, n bigint, total double").option("header", True).csv(path)
    return back.withColumn("line", F.monotonically_increasing_id())


@query("""SELECT concat_ws(',', vec_id::VARCHAR, coalesce(printf('%.6g', CASE WHEN vec_id % 5 > 0 THEN embedding[1]::DOUBLE / 1000 END), ''), coalesce(printf('%.6g', embedding[2]::DOUBLE * 1e7), ''),
  CASE WHEN vec_id % 4 > 0 THEN list_aggregate(list_transform(embedding[3:6], lambda x: printf('%.6g', x::DOUBLE)), 'string_agg', '|') ELSE '' END) AS line FROM embeddings""")
def six_digit_lines(spark, sf_dir):
    e, d = table(spark, sf_dir, "embeddings"), lambda k: F.get("embedding", F.lit(k)).cast("double")
    small = F.when(F.col("vec_id") % 5 > 0, d(0) / 1000)
    return sinks.csv_lines(e.select("vec_id", small.alias("a"), (d(1) * 1e7).alias("b"), F.when(F.col("vec_id") % 4 > 0, F.slice("embedding", 3, 4)).alias("c")))


@query("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE * 3 AS x FROM embeddings) SELECT CAST(label AS VARCHAR) AS component, 3 AS step, '2,3' AS saved, count(*) AS n, round(sqrt(sum(x * x)), 6) AS l2 FROM v GROUP BY label""")
def checkpoint_restored(spark, sf_dir):
    """The last of three steps of a state, of which two are kept, restored with its configuration, counts and norms checked."""
    path, e = folder(spark, "checkpoints"), table(spark, sf_dir, "embeddings")
    for step in (1, 2, 3, 3):  # the last one is there already
        state = e.select(F.col("label").cast("string").alias("component"), F.transform("embedding", lambda x: x.cast("double") * step).alias("values"))
        sinks.save_checkpoint(state, path, step, keep=2, config={"lr": 0.1})
    saved = ",".join(map(str, sinks.checkpoint_steps(spark, path)))
    back = sinks.load_checkpoint(spark, path, {"lr": 0.1})
    square = F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)
    return back.groupBy("component", "step").agg(F.sum(F.size("values")).alias("n"), F.round(F.sqrt(F.sum(square)), 6).alias("l2")).withColumn("saved", F.lit(saved))


# -- columns and samples -------------------------------------------------------------------------


@query("SELECT vec_id, label, embedding, label = 3 AS is_three FROM embeddings")
def numeric_columns(spark, sf_dir):
    """Columns by type: numbers, booleans and arrays of numbers; those whose names begin with ``pred`` are dropped."""
    e = table(spark, sf_dir, "embeddings").select("*", (F.col("label") == 3).alias("is_three"), F.col("label").cast("string").alias("name"), F.array(F.lit("x")).alias("tags"), F.lit(1).alias("pred_y"), F.lit(2).alias("predicted"))
    return relational.numeric_only(relational.drop_matching(e, "^pred.*$"))


@query("SELECT p_partkey, p_size, CAST(NULL AS DOUBLE) AS score FROM part WHERE p_size > 25")
def typed_empty(spark, sf_dir):
    """Rows in union with a frame that has types and no rows."""
    return relational.relaxed_union(table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey", "p_size"), relational.empty(spark, "p_partkey bigint, score double"))


@query("SELECT least(300, count(*)) AS n, least(300, count(*)) AS n_different, 0::BIGINT AS unknown, true AS again, count(*) AS all_rows FROM embeddings")
def uniform_sample_law(spark, sf_dir):
    """A seeded sample without replacement: its size, that its rows differ, are known and come again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    pick = lambda: sampling.uniform_sample(e, 300, 5, key="vec_id")
    one, two = pick().withColumn("a", F.lit(1)), pick().repartition(3).withColumn("b", F.lit(1))
    counts = one.join(two, "vec_id", "full").agg(F.count("a").alias("n"), F.countDistinct("vec_id").alias("n_different"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("again"))
    unknown = one.join(e, "vec_id", "left_anti").agg(F.count("*").alias("unknown"))
    return counts.join(F.broadcast(unknown)).join(F.broadcast(e.agg(F.count("*").alias("all_rows"))))
