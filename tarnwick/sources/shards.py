"""Recording shards in Arrow stream format, as a Spark data source for batches and streams: neighbouring shards share a task, record batches streamed.

Shards are the files ``*.arrow`` below a folder, in order of their paths.  Folders named ``split=...`` and ``subset=...`` give these two columns.
Filters on shard, split, subset and path drop whole shards before they are opened.  Filters on position are applied to record batches before
these leave Python, and those on index too, where option ``first`` tells how many rows stand before each shard; then shards
without a row that passes are dropped as well.  Filters come with option ``where``, which :func:`read_shards` writes, or from Spark with option ``push`` (true), which needs
``spark.sql.python.filterPushdown.enabled``.  The library's own readers don't use that: Spark 4.1 keeps pushed filters with the loaded frame, so that two uses of
one frame with different filters would get the same; a frame with ``push`` must be loaded for each use.

A shard that can't be opened, ends too early or lacks a column fails the job, or, with option ``bad`` set to ``rows``, ends with one row that has an ``error``
and nothing else but the shard and the position at which it ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .shard_sink import ShardWriter

SCHEMA = StructType([
    StructField("shard", LongType()), StructField("position", LongType()), StructField("index", LongType()), StructField("subset", StringType()), StructField("split", StringType()), StructField("path", StringType()),
    StructField("audio", StructType([StructField("bytes", BinaryType()), StructField("path", StringType())])), StructField("label", LongType()), StructField("error", StringType()),
])
_AUDIO = pa.struct([("bytes", pa.binary()), ("path", pa.string())])
_ARROW = pa.schema([("shard", pa.int64()), ("position", pa.int64()), ("index", pa.int64()), ("subset", pa.string()), ("split", pa.string()), ("path", pa.string()), ("audio", _AUDIO), ("label", pa.int64()), ("error", pa.string())])
#: Columns that have one value in a shard, and columns of row numbers.
_OF_SHARD, _OF_ROW = ("shard", "subset", "split", "path"), ("index", "position")
_COMPARE = {ds.GreaterThan: np.greater, ds.GreaterThanOrEqual: np.greater_equal, ds.LessThan: np.less, ds.LessThanOrEqual: np.less_equal}


class ShardPartition(ds.InputPartition):
    """A shard: its number (none in a stream), place, values of its folders, and the rows before and in it, where they are known."""

    def __init__(self, number: int | None, path: str, name: str, subset: str | None, split: str | None, first: int | None = None, many: int | None = None, size: int = 0):
        self.number, self.path, self.name, self.subset, self.split, self.first, self.many, self.size = number, path, name, subset, split, first, many, size
        self.more: list[ShardPartition] = []  # what the same task reads after it

    def of_shard(self, column: str):
        return {"shard": self.number, "subset": self.subset, "split": self.split, "path": self.name}[column]


#: Bytes of the shards that one task reads; each counts as so many more for being opened.
TASK_BYTES, OPEN_BYTES = 128 << 20, 1 << 20


def grouped(shards: list[ShardPartition], at_least: int = 16) -> list[ShardPartition]:
    """The first shard of each task, with those next to it that the task reads too: about ``TASK_BYTES``, or less where fewer than ``at_least`` tasks would come out."""
    most = min(TASK_BYTES, -(-sum(p.size + OPEN_BYTES for p in shards) // at_least))
    out, held = [], 0
    for p in shards:
        if not out or held + p.size + OPEN_BYTES > most:
            out.append(p)
            held = 0
        else:
            out[-1].more.append(p)
        held += p.size + OPEN_BYTES
    return out


def listed(uri: str) -> list[ShardPartition]:
    """All shards below ``uri``."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(uri)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    sizes = {f.path: f.size or 0 for f in found if f.is_file and f.base_name.endswith(".arrow") and f.base_name[0] not in "._"}
    out = []
    for k, path in enumerate(sorted(sizes)):
        name = path[len(root) :].lstrip("/")
        of = dict(part.split("=", 1) for part in name.split("/")[:-1] if "=" in part)
        out.append(ShardPartition(k, path, name, of.get("subset"), of.get("split"), size=sizes[path]))
    return out


def can_push(f: ds.Filter) -> bool:
    """Whether a filter is on a column that is known without reading, in a form that :func:`passes` knows."""
    inner = f.child if isinstance(f, ds.Not) else f
    known = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, *_COMPARE)
    return isinstance(inner, known) and len(inner.attribute) == 1 and inner.attribute[0] in (*_OF_SHARD, *_OF_ROW)


def column_of(f: ds.Filter) -> str:
    return (f.child if isinstance(f, ds.Not) else f).attribute[0]


def passes(f: ds.Filter, value) -> bool:
    """Whether one value passes; a comparison with null doesn't, and neither does its negation."""
    if isinstance(f, ds.Not):
        null = value is None and not isinstance(f.child, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe))
        return not null and not (isinstance(f.child, ds.In) and None in f.child.value) and not passes(f.child, value)
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    return value in f.value if isinstance(f, ds.In) else value == f.value if isinstance(f, ds.EqualTo) else bool(_COMPARE[type(f)](value, f.value))


def passing(f: ds.Filter, values: np.ndarray) -> np.ndarray:
    """Which of some whole numbers, none of them null, pass."""
    if isinstance(f, ds.Not):
        return np.zeros(len(values), bool) if isinstance(f.child, ds.In) and None in f.child.value else ~passing(f.child, values)
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return np.full(len(values), isinstance(f, ds.IsNotNull))
    if isinstance(f, ds.In):
        return np.isin(values, [x for x in f.value if x is not None])
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return values == f.value if f.value is not None else np.zeros(len(values), bool)
    return _COMPARE[type(f)](values, f.value)


def none_pass(f: ds.Filter, first: int, many: int) -> bool:
    """Whether it is clear that no whole number of a range passes, without going through the range."""
    last, inner = first + many - 1, f.child if isinstance(f, ds.Not) else f
    if many and isinstance(inner, ds.In):
        inside = len({x for x in inner.value if x is not None and first <= x <= last})
        return inside == many if isinstance(f, ds.Not) else inside == 0
    if many and type(inner) in _COMPARE:  # true from one end up to some place
        return not passing(f, np.array([first, last])).any()
    if many and isinstance(inner, ds.EqualTo):
        return first == last == inner.value if isinstance(f, ds.Not) else inner.value is None or not first <= inner.value <= last
    return not many


def batches(partition: ShardPartition, uri: str, label: str, audio: bool, bad: bool, filters: list[ds.Filter], pushed: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one shard that pass ``filters``, and perhaps what ended it: whatever the filters on rows, unless Spark ``pushed`` some."""
    from pyarrow import fs

    position = 0
    of_row = [f for f in filters if column_of(f) in _OF_ROW]

    def made(n: int, **columns) -> pa.RecordBatch:
        columns |= {"shard": pa.array([partition.number] * n, pa.int64()), **{c: pa.array([partition.of_shard(c)] * n, pa.string()) for c in ("subset", "split", "path")}}
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

    try:
        files, _ = fs.FileSystem.from_uri(uri)
        with files.open_input_stream(partition.path) as f, pa.ipc.open_stream(f) as stream:
            for name, kind in (("audio", pa.types.is_struct), (label, pa.types.is_int64)):
                at = stream.schema.get_field_index(name)
                if at < 0 or not kind(stream.schema.field(at).type):
                    raise ValueError(f"{partition.path}: column {name} is missing or of another type")
            for batch in stream:
                n = len(batch)
                place = np.arange(position, position + n)
                index = None if partition.first is None else partition.first + place
                keep = np.ones(n, bool)
                for f in of_row:
                    value = place if column_of(f) == "position" else index
                    keep &= passing(f, value) if value is not None else passes(f, None)
                columns = {"position": pa.array(place, pa.int64()), "label": batch[label]}
                if index is not None:
                    columns["index"] = pa.array(index, pa.int64())
                if audio:
                    parts = batch["audio"]
                    columns["audio"] = pa.StructArray.from_arrays([pc.struct_field(parts, c).cast(t) for c, t in (("bytes", pa.binary()), ("path", pa.string()))], ["bytes", "path"], mask=parts.is_null())
                out = made(n, **columns)
                position += n
                yield out if keep.all() else out.filter(pa.array(keep))
    except Exception as e:  # what a broken file raises is open
        if not bad:
            raise
        if not pushed:
            of_row = []
        if all(passes(f, None if column_of(f) == "index" else position) for f in of_row):
            yield made(1, position=pa.array([position], pa.int64()), error=pa.array([f"{type(e).__name__}: {e}"]))


_FILTERS = {
    "=": lambda c, v: ds.EqualTo((c,), v), "in": lambda c, v: ds.In((c,), tuple(v)), "not in": lambda c, v: ds.Not(ds.In((c,), tuple(v))),
    **{sign: (lambda c, v, k=k: k((c,), v)) for sign, k in ((">", ds.GreaterThan), (">=", ds.GreaterThanOrEqual), ("<", ds.LessThan), ("<=", ds.LessThanOrEqual))},
}


class _Options:
    """What both readers take: ``path``, ``label`` (the class column), ``audio`` (false leaves the recordings out), ``bad`` (rows or fail), ``first``, ``where``."""

    def __init__(self, options: dict[str, str]):
        self.path, self.label = options["path"], options.get("label", "label")
        self.audio, self.bad = options.get("audio", "true") == "true", options.get("bad", "fail") == "rows"
        self.first = json.loads(options.get("first", "{}"))
        self.pushed = False
        self.filters: list[ds.Filter] = [_FILTERS[sign](column, value) for column, sign, value in json.loads(options.get("where", "[]"))]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        for shard in (partition, *partition.more):
            yield from batches(shard, self.path, self.label, self.audio, self.bad, self.filters, self.pushed)


class ShardReader(_Options, ds.DataSourceReader):
    def partitions(self) -> list[ds.InputPartition]:
        return grouped(self.wanted())

    def wanted(self) -> list[ShardPartition]:
        """The shards in which a row may pass."""
        out = []
        for p in listed(self.path):
            p.first, p.many = self.first.get(p.name, (None, None))
            if all(passes(f, p.of_shard(column_of(f))) for f in self.filters if column_of(f) in _OF_SHARD):
                # a shard that may end with an error row is opened all the same
                if self.bad or p.many is None or not any(none_pass(f, p.first if column_of(f) == "index" else 0, p.many) for f in self.filters if column_of(f) in _OF_ROW):
                    out.append(p)
        return out


class PushingShardReader(ShardReader):
    """One that takes filters from Spark."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if can_push(f):
                self.filters.append(f)
                self.pushed = True
            else:
                yield f


class ShardStreamReader(_Options, ds.DataSourceStreamReader):
    """Every shard is read once, in the trigger that first sees it.  The offset holds the shards' names, so a restart from a checkpoint goes on where it ended.

    A shard must not change once its name ends in ``.arrow``.
    """

    def initialOffset(self) -> dict:
        return {"shards": []}

    def latestOffset(self) -> dict:
        return {"shards": [p.name for p in listed(self.path)]}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        seen, wanted = set(start["shards"]), set(end["shards"])
        out = [p for p in listed(self.path) if p.name in wanted and p.name not in seen]
        for p in out:
            p.number = None
        return grouped(out)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ShardSource(ds.DataSource):
    """``spark.read``, ``spark.readStream`` or ``df.write`` with ``.format("shards").option("path", uri)``; options as in :class:`_Options` and :class:`ShardWriter`."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return PushingShardReader(self.options) if self.options.get("push") == "true" else ShardReader(self.options)

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:
        return ShardStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceArrowWriter:
        return ShardWriter(self.options, schema, overwrite)


def split_sizes(rows: DataFrame, split: str, label: str) -> DataFrame:
    """(split, n, n_classes): rows and different labels of each split, null labels counting as rows only."""
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.countDistinct(label).alias("n_classes"))


def read_shards(
    spark: SparkSession, uri: str, label: str = "label", split: str | None = None, subset: str | None = None, exclude: tuple[int, ...] = (), bad: str = "fail", where: tuple[tuple[str, str, object], ...] = ()
) -> DataFrame:
    """Rows of the shards of a split and subset (all, if none is named) with ``index``, their place over these shards in order of path.

    ``exclude``: indices that are left out; one that no row has raises ValueError.  ``where``: further filters (column, sign, value) on shard, path, index
    or position, signs =, in, not in, <, <=, >, >=.  A pass that leaves the recordings out counts each shard's rows; the driver gets one number a
    shard.  Shards in which nothing passes are not opened again, those of other splits and subsets never.
    """
    spark.dataSource.register(ShardSource)
    of_split = [[c, "=", v] for c, v in (("split", split), ("subset", subset)) if v is not None]
    rows = spark.read.format("shards").options(label=label, bad=bad)
    at = rows.options(audio="false", where=json.dumps(of_split)).load(uri)
    first, total = {}, 0
    for r in at.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("n")).orderBy("path").collect():
        first[r["path"]] = (total, r["n"])
        total += r["n"]
    if exclude and not 0 <= min(exclude) <= max(exclude) < total:
        raise ValueError(f"excluded indices are out of range (0..{total - 1})")
    filters = [*of_split, *map(list, where), *([["index", "not in", list(exclude)]] if exclude else [])]
    return rows.options(audio="true", first=json.dumps(first), where=json.dumps(filters)).load(uri)


def stream_shards(spark: SparkSession, uri: str, label: str = "label", bad: str = "fail") -> DataFrame:
    """A stream of the rows of all shards, those that are there and those to come; ``path`` and ``position`` tell rows apart, number and index are null."""
    spark.dataSource.register(ShardSource)
    return spark.readStream.format("shards").options(label=label, bad=bad).load(uri)
