"""Training logs, run histories and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "run_id string, seed bigint, step bigint, _step bigint, loss double, entropy double, _timestamp double"


def log_values(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, line, step, value) of the lines that match: group 1 is the step, group 2 the value."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    hit = lines.where(F.col("value").rlike(pattern))
    return hit.select("file", "line", F.regexp_extract("value", pattern, 1).cast("bigint").alias("step"), F.regexp_extract("value", pattern, 2).cast("double").alias("value"))


def first_match(spark: SparkSession, path: str, pattern: str, last: bool = False) -> str | None:
    """Group 1 of the first line that matches, or of the last."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value").where(F.col("value").rlike(pattern))
    pick = F.max_by if last else F.min_by
    return lines.agg(pick(F.regexp_extract("value", pattern, 1), "line")).first()[0]


def history(spark: SparkSession, path: str, metrics: tuple[str, ...] = ("loss", "entropy"), schema: str = HISTORY) -> DataFrame:
    """JSON-lines history rows that have a step and a metric; a missing step falls back to the counter.

    Where there are none, all columns are scanned: the wanted ones may stand under ``summary``.
    """

    def known(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("step", F.coalesce("step", "_step"))
        return rows.where(F.col("step").isNotNull() & F.coalesce(*(F.col(m) for m in metrics)).isNotNull())

    rows = known(spark.read.schema(schema).json(path))
    if rows.limit(1).count():
        return rows
    # nothing under the wanted names: every column that is there, with the wanted ones where they exist under a run's summary
    full = spark.read.json(path)
    inner = {f.name for f in full.schema["summary"].dataType} if "summary" in full.columns and hasattr(full.schema["summary"].dataType, "fields") else set()
    wanted = [(c.split()[0], c.split()[1]) for c in schema.split(", ")]
    pick = lambda c: F.col(c) if c in full.columns else F.col(f"summary.{c}") if c in inner else F.lit(None)
    return known(full.select(*(pick(c).cast(t).alias(c) for c, t in wanted)))


def summaries(spark: SparkSession, path: str, schema: str, default_optimizer: str = "adam") -> DataFrame:
    """Run summaries with a default optimiser and rows without a loss or rate left out."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("optimizer", F.coalesce("optimizer", F.lit(default_optimizer))).dropna(subset=["loss", "lr"])
