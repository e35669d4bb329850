"""Tables written once in the folder that driver and executors share (``spark.checkpoint.dir``).

Where that is unset (tests, a laptop) a temporary folder is made and set once for the session, on a local master only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
TOP = "tarnwick"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; made only where the session names none."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{TOP}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a scan of its files: whatever is evaluated again gives the same rows, on any executor.

    This cuts the lineage: a lost executor costs the running tasks only.  Files stay until :func:`forget` or
    :func:`clear`, or until the owner of the folder removes them, because scans of them are lazy.
    """
    path = folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`written` gave, when nothing reads it any more."""
    _delete(df.sparkSession, df._written_at)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this library in the session's shared folder, when no result is read any more."""
    _delete(spark, f"{shared_dir(spark)}/{TOP}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
