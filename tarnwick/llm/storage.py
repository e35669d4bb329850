"""Intermediate tables in the folder that all executors share; see :mod:`tarnwick.scratch`."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..scratch import clear, forget, shared_dir
from ..scratch import folder as new_path
from ..scratch import written as materialise

__all__ = ["arrow_rows", "clear", "forget", "materialise", "new_path", "shared_dir"]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs that run pass at most ``rows`` rows to Python at a time: for rows of many kilobytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
