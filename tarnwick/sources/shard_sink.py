"""Writing recording shards: what :mod:`tarnwick.sources.shards` reads, written by tasks and put in place when all of them have ended."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

FOLDERS = ("split", "subset")
#: Shards that a task writes at the same time; with more folders than these it ends the one begun first.
MOST_OPEN = 16
#: Files that are put in place at the same time.
MOVERS = 16
_AUDIO = pa.struct([("bytes", pa.binary()), ("path", pa.string())])


@dataclass
class ShardsWritten(ds.WriterCommitMessage):
    """The files of a task, each where it lies now and where it belongs."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class ShardWriter(ds.DataSourceArrowWriter):
    """Rows (``audio``, the class column, perhaps ``split`` and ``subset``) as shards of at most ``rows`` rows.

    A task writes under names that no reader lists; only when all tasks have ended are their files moved to
    ``split=.../subset=.../<task>-<count>-<write>.arrow``, so a task that is tried again or lost leaves nothing that is read.
    A null split or subset has no folder.  Rows keep the order of tasks and of rows within them.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.uri, self.label, self.rows, self.overwrite = options["path"], options.get("label", "label"), int(options.get("rows", "4096")), overwrite
        self.name = uuid.uuid4().hex
        self.shard_schema = pa.schema([("audio", _AUDIO), (self.label, pa.int64())])
        missing = {"audio", self.label} - set(schema.names)
        if missing or self.rows < 1:
            raise ValueError(f"shards need the columns audio and {self.label}, and a positive number of rows")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ShardsWritten:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.uri)
        task, done, open_now = TaskContext.get().partitionId(), ShardsWritten(), {}

        def end(folders: tuple) -> None:
            stream, out, _ = open_now.pop(folders)
            stream.close()
            out.close()

        def begin(folders: tuple) -> None:
            if len(open_now) == MOST_OPEN:
                end(next(iter(open_now)))
            at = f"{root}/_{self.name}/{uuid.uuid4().hex}"
            to = [root, *(f"{c}={v}" for c, v in zip(FOLDERS, folders, strict=True) if v is not None), f"{task:06d}-{len(done.moves):06d}-{self.name[:8]}.arrow"]
            files.create_dir(f"{root}/_{self.name}", recursive=True)
            out = files.open_output_stream(at)
            open_now[folders] = [pa.ipc.new_stream(out, self.shard_schema), out, 0]
            done.moves.append((at, "/".join(to)))

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            of = [table[c] if c in table.column_names else pa.chunked_array([pa.nulls(len(table), pa.string())]) for c in FOLDERS]
            audio = table["audio"].cast(_AUDIO)
            rows = pa.Table.from_arrays([audio, table[self.label].cast(pa.int64())], schema=self.shard_schema)
            keys = list(zip(*(c.to_pylist() for c in of), strict=True))
            for folders in dict.fromkeys(keys):
                mine = rows.filter(pa.array([k == folders for k in keys])) if len(set(keys)) > 1 else rows
                at = 0
                while at < len(mine):
                    if folders not in open_now:
                        begin(folders)
                    shard = open_now[folders]
                    part = mine.slice(at, self.rows - shard[2])
                    shard[0].write_table(part)
                    shard[2] += len(part)
                    at += len(part)
                    if shard[2] == self.rows:
                        end(folders)
        for folders in list(open_now):
            end(folders)
        return done

    def commit(self, messages: list[ShardsWritten | None]) -> None:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.uri)
        old = [f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.base_name.endswith(".arrow")]
        for path in old if self.overwrite else ():
            files.delete_file(path)
        moves = [move for m in messages if m for move in m.moves]
        for folder in sorted({to.rsplit("/", 1)[0] for _, to in moves}):
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:  # a move waits for the file system, not for this process
            for _ in pool.map(lambda move: files.move(*move), moves):
                pass
        self._tidy(files, root)

    def abort(self, messages: list[ShardsWritten | None]) -> None:
        from pyarrow import fs

        self._tidy(*fs.FileSystem.from_uri(self.uri))

    def _tidy(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/_{self.name}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_{self.name}")


def write_shards(rows: DataFrame, uri: str, label: str = "label", shard_rows: int = 4096, mode: str = "append") -> None:
    """``rows`` as shards under ``uri``; :class:`ShardWriter` tells which columns and names."""
    from .shards import ShardSource

    rows.sparkSession.dataSource.register(ShardSource)
    columns = ["audio", label, *(c for c in FOLDERS if c in rows.columns)]
    rows.select(*columns).write.format("shards").mode(mode).options(label=label, rows=str(shard_rows)).save(uri)
