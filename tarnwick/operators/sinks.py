"""Writing results: one file an experiment, error lines, CSV exports, step checkpoints."""

from __future__ import annotations

import json
import platform
import shutil
import subprocess
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Fixed value: predictions are kept in a result up to this many.
MOST_PREDICTIONS = 50_000


def provenance(df: DataFrame) -> DataFrame:
    """``df`` plus argv, commit, time and host of this run."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
        dirty = subprocess.run(["git", "status", "--porcelain"], capture_output=True, text=True, timeout=10).stdout.strip()
    except OSError:
        commit = dirty = ""
    more = {"argv": " ".join(sys.argv), "git_commit": commit + "-dirty" * bool(dirty), "posix": time.time(), "hostname": platform.node(), "gpu_name": _gpu_name()}
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def _gpu_name() -> str | None:
    """What the driver's accelerator is called, if its tool is there."""
    if not shutil.which("nvidia-smi"):
        return None
    found = subprocess.run(["nvidia-smi", "--query-gpu=name", "--format=csv,noheader"], capture_output=True, text=True, timeout=10).stdout.split("\n")
    return found[0].strip() or None


def log_metrics(rows: DataFrame, path: str) -> None:
    """Append rows of metrics (run_id, step, any others) to a history of JSON lines; values that are null are left out."""
    rows.write.mode("append").json(path)


def write_result(result: DataFrame, predictions: DataFrame | None, path: str, most: int = MOST_PREDICTIONS) -> None:
    """Append one result row; its predictions (example_id, y_true, y_pred, y_score) go in as lists while there are fewer than ``most``."""
    if predictions is not None and predictions.limit(most).count() < most:
        listed = predictions.agg(F.array_sort(F.collect_list(F.struct("example_id", "y_true", "y_pred", "y_score"))).alias("p"))
        lists = listed.select(F.col("p.example_id").alias("pred_example_ids"), *(F.col(f"p.{c}").alias(f"pred_{c}") for c in ("y_true", "y_pred", "y_score")))
        result = result.crossJoin(lists)
    provenance(result).coalesce(1).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All results under differing schemas, or None where there are none yet."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def already_ran(spark: SparkSession, path: str, key: dict[str, object]) -> bool:
    """Whether a result with these key values is there; the filter reaches the Parquet scan."""
    found = read_results(spark, path)
    if found is None:
        return False
    for k, v in key.items():
        found = found.where(F.col(k) == F.lit(v))
    return bool(found.limit(1).count())


def write_errors(rows: DataFrame, path: str) -> None:
    """Append the rows that are not ``ok`` as JSON lines."""
    rows.where(~F.col("ok")).drop("ok").write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, order: tuple[str, ...], columns: tuple[str, ...] | None = None) -> None:
    """One sorted CSV file with a head line, for reports of a few rows."""
    rows.select(*(columns or rows.columns)).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def six_digits(c: Column) -> Column:
    """A number to six significant digits without zeros at the end."""
    full = F.format_string("%.6g", c.cast("double"))
    return F.when(c.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(full, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """Rows as lines: numbers to six significant digits, lists joined by a bar, nulls empty."""
    cells = []
    for f in rows.schema:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.array_join(F.transform(c, six_digits), "|")
        elif f.dataType.typeName() in ("double", "float"):
            c = six_digits(c)
        cells.append(F.when(F.col(f.name).isNull(), "").otherwise(c.cast("string")))
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def _summary(state: DataFrame) -> DataFrame:
    """(component, n, l2): how many values a state (component, values) has, and their Euclidean length."""
    squares = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return state.groupBy("component").agg(F.sum(F.size("values")).cast("bigint").alias("n"), F.sqrt(F.sum(squares)).alias("l2"))


def save_checkpoint(state: DataFrame, path: str, step: int, every: int = 1, keep: int = 5, config: dict | None = None) -> bool:
    """Write a step's state unless it is there or off the interval, and delete all but the last ``keep`` steps.

    With ``config`` it is written too, with counts and norms of the state's components, for :func:`load_checkpoint` to check.
    """
    spark = state.sparkSession
    steps = checkpoint_steps(spark, path)
    if step in steps or step % every:
        return False
    if config is not None:
        _summary(state).withColumn("config", F.lit(json.dumps(config, sort_keys=True))).coalesce(1).write.mode("overwrite").parquet(f"{path}/checks-{step}")
    state.write.parquet(f"{path}/step={step}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in sorted([*steps, step])[:-keep]:
        for name in (f"step={old}", f"checks-{old}"):
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return True


def checkpoint_steps(spark: SparkSession, path: str) -> list[int]:
    """The steps that are saved under ``path``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    return sorted(int(s.getPath().getName().removeprefix("step=")) for s in files.listStatus(root) if s.getPath().getName().startswith("step="))


def load_checkpoint(spark: SparkSession, path: str, config: dict | None = None, tolerance: float = 1e-6) -> DataFrame | None:
    """The state of the last saved step, with its ``step``.

    With ``config`` it must be the one that was saved, and the state's counts and norms those of then; a step that was saved without one raises ValueError.
    """
    steps = checkpoint_steps(spark, path)
    if steps and config is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/checks-{steps[-1]}")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise ValueError(f"step {steps[-1]} was saved without a configuration")
        saved = spark.read.parquet(f"{path}/checks-{steps[-1]}")
        if {r["config"] for r in saved.select("config").distinct().collect()} - {json.dumps(config, sort_keys=True)}:
            raise ValueError("the checkpoint was saved under another configuration")
        now = _summary(spark.read.parquet(f"{path}/step={steps[-1]}")).select("component", F.col("n").alias("n_now"), F.col("l2").alias("l2_now"))
        same = F.col("n").eqNullSafe(F.col("n_now")) & (F.abs(F.col("l2") - F.col("l2_now")) <= tolerance * F.greatest(F.col("l2"), F.lit(1.0)))
        wrong = saved.join(now, "component", "full").where(~F.coalesce(same, F.lit(False))).select("component").limit(5).collect()
        if wrong:
            raise ValueError(f"counts or norms differ from those saved: {[r['component'] for r in wrong]}")
    return spark.read.parquet(f"{path}/step={steps[-1]}").withColumn("step", F.lit(steps[-1])) if steps else None
