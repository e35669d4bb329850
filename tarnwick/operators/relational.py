"""Relational helpers for experiment tables: keys, grids, pending work, relaxed unions, pivots, flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("task_name", "model_org", "model_ckpt", "clf", "n_train")


def pending(configs: DataFrame, done: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``configs`` without a row in ``done`` of the same key."""
    return configs.join(done.select(*key).distinct(), list(key), "left_anti")


def grid(spark: SparkSession, **lists: list) -> DataFrame:
    """All combinations of parameter lists, which are the driver's own configuration."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in lists.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A frame without rows, but with its columns and their types."""
    return spark.createDataFrame([], schema)


def with_names(rows: DataFrame, names: DataFrame, label: str, name: str, most: int = 100_000) -> DataFrame:
    """``rows`` with ``name`` of their ``label`` from a dictionary of both columns; an unknown or null label has none.

    A dictionary of at most ``most`` rows is broadcast.
    """
    held = names.select(label, name)
    return rows.join(F.broadcast(held) if held.count() <= most else held, label, "left")


def experiment_key(checkpoint: Column, organisation: Column, model: Column, own: str = "local") -> tuple[Column, Column]:
    """Organisation and model name of an experiment: those of its checkpoint's path where it has one."""
    has = F.coalesce(checkpoint != "", F.lit(False))
    return F.when(has, own).otherwise(organisation), F.when(has, last_part(F.rtrim(checkpoint, F.lit("/")))).otherwise(model)


def as_json(df: DataFrame, *columns: str) -> Column:
    """Columns of a configuration as one JSON text; nulls are left out."""
    return F.to_json(F.struct(*(columns or df.columns)))


def latest(results: DataFrame, key: tuple[str, ...], order: str, *values: str) -> DataFrame:
    """One row for each key: the values of the row with the largest ``order``."""
    return results.groupBy(*key).agg(*(F.max_by(v, order).alias(v) for v in values))


def wide_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the wider number, else string."""
    order = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    if type(a) is type(b):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if type(a) in order and type(b) in order:
        return max(a, b, key=lambda t: order.index(type(t)))
    return T.StringType()


def relaxed_union(*frames: DataFrame) -> DataFrame:
    """All rows under all columns: missing ones are null, differing types are widened."""
    types: dict[str, T.DataType] = {}
    for f in frames:
        for c in f.schema:
            types[c.name] = wide_type(types[c.name], c.dataType) if c.name in types else c.dataType
    cast = lambda f: f.select(*(F.col(c).cast(t).alias(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))
    return reduce(DataFrame.unionByName, map(cast, frames))


def flatten(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Structs as dotted columns, arrays as strings, without the dotted names in ``drop``."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for f in schema:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                c = F.col(".".join(f"`{x}`" for x in at))
                yield ".".join(at), F.to_json(c) if isinstance(f.dataType, T.ArrayType) else c

    return df.select(*(c.alias(name) for name, c in leaves(df.schema) if name not in drop))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """``df`` without the columns whose name matches a regular expression from its start."""
    import re

    return df.drop(*(c for c in df.columns if re.match(pattern, c)))


def numeric_only(df: DataFrame) -> DataFrame:
    """The numeric, boolean and numeric-array columns of ``df``."""
    flat = lambda t: t.elementType if isinstance(t, T.ArrayType) else t
    return df.select(*(f.name for f in df.schema if isinstance(flat(f.dataType), (T.NumericType, T.BooleanType))))


def measured_columns(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Those of ``names`` that hold a value in any row, from one aggregation."""
    row = df.agg(*(F.bool_or(F.col(c).isNotNull()).alias(c) for c in names)).first()
    return [c for c in names if row[c]]


def coalesced_step(first: Column, second: Column, zero_is_missing: bool = False) -> Column:
    """``first`` unless missing, else ``second``; a zero counts as missing if asked for."""
    return F.coalesce(F.nullif(first, F.lit(0)) if zero_is_missing else first, second)


def last_part(c: Column, by: str = "/") -> Column:
    """What stands after the last separator."""
    return F.element_at(F.split(c, by), -1)


def split_right(c: Column, by: str = "_") -> tuple[Column, Column]:
    """What stands before and after the last separator."""
    return F.regexp_extract(c, f"^(.*){by}([^{by}]*)$", 1), F.regexp_extract(c, f"^(.*){by}([^{by}]*)$", 2)


def report(results: DataFrame, tasks: list[str], rows: tuple[str, ...] = ("model_ckpt", "clf", "n_train"), order: str = "file_name", value: str = "cmap") -> DataFrame:
    """A row for each model, classifier and training size, a column for each task: the last value written, ``-`` if none."""
    table = results.groupBy(*rows).pivot("task_name", tasks).agg(F.max_by(value, order))
    size = F.when(F.col("n_train") == -1, "all").otherwise(F.col("n_train").cast("string"))
    shown = {t: F.when(F.col(t).isNull(), "-").otherwise(F.format_string("%.2f", F.col(t) * 100)) for t in tasks}  # a formatted null is no null
    return table.withColumns(shown | {"n_train": size})


def checkpoint_deltas(checkpoints: DataFrame, log: DataFrame) -> DataFrame:
    """Norms of checkpoints (step, norm) beside the first norm that a log (step, line, value) has for the step, and all that it has."""
    logged = log.groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("logged"))
    both = checkpoints.join(logged, "step", "left")
    return both.select("step", "norm", F.get("logged", F.lit(0)).alias("first_logged"), (F.col("norm") - F.get("logged", F.lit(0))).alias("delta"), "logged")
