"""Streaming queries on ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import rounded
from ..operators import diagnostics as D
from ..operators import ordered
from ..scratch import folder
from ..streaming import stateful
from .diagnostics import SIZE, N, batches
from .registry import ORACLE_SQL, query, table


def scratch(spark) -> str:
    """A new folder for a stream's input, output and state."""
    return folder(spark, "streams")


def event_stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


CAPACITY, LEAST = 64, 32


@query(f"""WITH l AS (SELECT event_id, event_id % (SELECT greatest(1, (count(*) + 24999) // 25000) FROM events) AS lane FROM events)
SELECT event_id AS id, CAST(lane AS BIGINT) AS lane, true AS bounded, true AS after_least, CAST(count(*) OVER (PARTITION BY lane) AS BIGINT) AS given FROM l""")
def stream_shuffle(spark, sf_dir):
    """Every row once, with its lane and how many different turns the lane had.

    ``bounded``: no more rows than the capacity were held when it came in; ``after_least``: a lane's first row was one of those that came in before its first turn could be.
    """
    path = scratch(spark)
    events = table(spark, sf_dir, "events")
    lanes = stateful.lanes_of(events.count())
    rows = events.select(F.col("event_id").alias("id"), (F.col("event_id") % lanes).alias("lane"), F.lit(False).alias("last"))
    rows.write.parquet(f"{path}/in/0")
    ends = spark.range(lanes).select(F.lit(None).cast("bigint").alias("id"), F.col("id").alias("lane"), F.lit(True).alias("last"))
    ends.write.parquet(f"{path}/in/1")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in/*")
    given = stateful.run_available(stateful.shuffle_buffer(stream, CAPACITY, 5, least=LEAST), path)
    turns = given.groupBy("lane").agg(F.countDistinct("turn").alias("given"))
    first = (F.col("turn") > 0) | (F.col("arrived") < CAPACITY)
    return given.join(turns, "lane").select("id", "lane", (F.col("turn") > F.col("arrived") - CAPACITY).alias("bounded"), first.alias("after_least"), "given")


@query(ORACLE_SQL["acf_mod"])
def stream_acf(spark, sf_dir):
    path = scratch(spark)
    rows = batches(spark, sf_dir).select("step", D.bucket(F.col("index"), N, "mod", SIZE).cast("bigint").alias("bucket"), F.lit(False).alias("last"))
    rows.repartitionByRange(4, "step").write.parquet(f"{path}/in/0")
    ends = spark.range(N).select(F.lit(None).cast("bigint").alias("step"), F.col("id").alias("bucket"), F.lit(True).alias("last"))
    ends.write.parquet(f"{path}/in/1")
    for part in (0, 1):  # two runs: the second goes on from the first one's state
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in/[0-{part}]")
        pairs = stateful.run_available(stateful.lagged_counts(stream), path)
    return D.correlation_of_pairs(pairs, N).withColumn("acf", rounded("acf", 6))


@query("""WITH b AS (SELECT DISTINCT event_id // 100 AS step, user_id AS index FROM events)
SELECT s.step, count(DISTINCT b.index) AS n_unique FROM (SELECT DISTINCT step FROM b) s JOIN b ON b.step <= s.step AND b.step > s.step - 10 GROUP BY s.step""")
def stream_sliding_unique(spark, sf_dir):
    steps = event_stream(spark, sf_dir).select(F.expr("event_id div 100").alias("step"), F.col("user_id").alias("index"))
    moves = stateful.run_available(stateful.distinct_moves(steps, 10), scratch(spark))
    seen = table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("step"), F.col("user_id").alias("index"))
    last = seen.groupBy("index").agg((F.max("step") + 10).alias("step")).select("step", F.lit(-1).cast("bigint").alias("d"))
    # steps without a move keep the sum before them
    wanted = seen.select("step", F.lit(0).cast("bigint").alias("d")).distinct()
    by_step = moves.unionByName(last).unionByName(wanted).groupBy("step").agg(F.sum("d").alias("d"))
    running = ordered.running_sums(by_step, {"n_unique": "d"}, ("step",))
    return running.join(wanted.select("step"), "step", "left_semi").select("step", "n_unique")
