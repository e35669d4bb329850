"""Stateful operators on streams: a bounded shuffle buffer, lagged counts, and entries and leavings of a sliding distinct count.

State is keyed and read by item: a trigger reads and writes the slots and numbers that its rows touch, not all that is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Buffer(StatefulProcessor):
    """The shuffle buffer of one lane: a row in each slot 0 to ``held`` - 1 of a map, and how many rows went in and out."""

    def __init__(self, key: str, capacity: int, least: int, seed: int):
        self.key, self.capacity, self.least, self.seed = key, capacity, least, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot bigint", "value bigint, arrived bigint")
        self.counts = handle.getValueState("counts", "held bigint, turn bigint, filled boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, turn, filled = self.counts.get() if self.counts.exists() else (0, 0, False)
        kept = held  # slots below it are in the state unless they are in ``seen``
        seen: dict[int, tuple[int, int]] = {}
        first, lane, end = turn, int(key[0]), False  # rows given out before ``out``
        draw = np.random.default_rng([self.seed, lane, turn, held])
        out: list[tuple[int, int]] = []

        def pop() -> None:
            """Give out a row at random; the last one takes its slot."""
            nonlocal held
            k, held = int(draw.integers(held)), held - 1
            for x in (k, held):
                if x not in seen:
                    seen[x] = tuple(self.slots.getValue((x,)))
            out.append(seen[k])
            seen[k] = seen[held]

        for part in rows:
            end |= bool(part["last"].any())
            for v in part.loc[~part["last"], self.key].tolist():
                seen[held] = int(v), first + len(out) + held
                held += 1
                filled |= held >= self.least
                if held >= self.capacity:
                    pop()
            yield from self._given(lane, first, out)
            first, out[:] = first + len(out), []
        while held and (end or filled and held > self.least):  # what waits for no more rows
            pop()
        yield from self._given(lane, first, out)
        for x, v in seen.items():
            if x < held:
                self.slots.updateValue((x,), v)
        for x in range(held, kept):
            self.slots.removeKey((x,))
        self.counts.update((held, first + len(out), filled and not end))

    def _given(self, lane: int, turn: int, out: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if out:
            values, arrived = np.array(out, np.int64).T
            yield pd.DataFrame({self.key: values, "lane": lane, "turn": np.arange(turn, turn + len(out)), "arrived": arrived})

    def close(self) -> None:
        pass


def shuffle_buffer(rows: DataFrame, capacity: int, seed: int, key: str = "id", least: int | None = None) -> DataFrame:
    """(key, lane, turn, arrived): the rows' keys in the order in which a bounded buffer for each lane gives them out, and their place among those that came in.

    A buffer never holds more than ``capacity`` rows, gives out none before it has held ``least`` (half of the capacity, unless given), and then at
    random: one for each row that would go beyond the capacity, and at the end of a trigger down to ``least``.  A row with a true ``last``
    ends its lane: the lane gives out all it holds, whatever the least.  Rows: (key, lane, last).  Lanes are the caller's: as many as the input
    asks for, such as its shards or :func:`lanes_of`.
    """
    if not 0 < capacity or least is not None and not 0 <= least <= capacity:
        raise ValueError("a buffer holds at least a row, and its least fill is at most its capacity")
    buffer = Buffer(key, capacity, capacity // 2 if least is None else least, seed)
    return rows.groupBy("lane").transformWithStateInPandas(buffer, f"{key} bigint, lane bigint, turn bigint, arrived bigint", outputMode="Append", timeMode="None")


def lanes_of(n: int, lane_rows: int = 25_000) -> int:
    """How many lanes ``n`` rows ask for."""
    return max(1, -(-n // lane_rows))


class Lagged(StatefulProcessor):
    """Of one bucket: the step that is still open with its count so far, and the last one before it with its count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("steps", "step bigint, n bigint, last bigint, before bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, n, last, before = self.state.get() if self.state.exists() else (None, 0, None, 0)
        counts: dict[int, int] = {}
        end = False
        for part in rows:
            end |= bool(part["last"].any())
            for s, k in part.loc[~part["last"], "step"].value_counts().items():
                counts[int(s)] = counts.get(int(s), 0) + int(k)
        out = []
        for s in sorted(counts):
            if step is not None and s < step:
                raise ValueError(f"step {s} comes after step {step}")
            if s != step:
                if step is not None:
                    out.append((step, n, before if last == step - 1 else 0))
                    last, before = step, n
                step, n = s, 0
            n += counts[s]
        if end and step is not None:
            out.append((step, n, before if last == step - 1 else 0))
            step, n, last, before = None, 0, step, n
        self.state.update((step, n, last, before))
        if out:
            s, k, m = zip(*out, strict=True)
            yield pd.DataFrame({"step": np.array(s, np.int64), "bucket": int(key[0]), "n": np.array(k, np.int64), "before": np.array(m, np.int64)})

    def close(self) -> None:
        pass


def lagged_counts(rows: DataFrame) -> DataFrame:
    """(step, bucket, n, before): the count of each bucket at each step with its count at the step before, from a stream of (step, bucket, last).

    Steps of a bucket must come in order; one ends when the bucket's next step comes, or with a row whose ``last`` is true.  State is two counts a bucket, so
    measures of neighbouring steps go on from one trigger, or run, to the next.
    """
    return rows.groupBy("bucket").transformWithStateInPandas(Lagged(), "step bigint, bucket bigint, n bigint, before bigint", outputMode="Append", timeMode="None")


def distinct_moves(rows: DataFrame, window: int) -> DataFrame:
    """(step, d): +1 where an index enters a window of ``window`` steps and -1 where it leaves, from a stream of (step, index).

    State is one number for each index: the step at which it leaves unless it comes again.  Steps must come in
    order; a running sum of the moves is the distinct count, up to the leavings still to come.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        steps, moves = [], []
        for s in np.unique(pd.concat(list(parts))["step"].to_numpy()):
            if until is None or s >= until:
                if until is not None:
                    steps.append(until)
                    moves.append(-1)
                steps.append(int(s))
                moves.append(1)
            until = int(s) + window
        state.update((until,))
        yield pd.DataFrame({"step": np.array(steps, np.int64), "d": np.array(moves, np.int64)})

    return rows.groupBy("index").applyInPandasWithState(run, "step bigint, d bigint", "until bigint", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet under ``path``, and read the result; it goes on from the checkpoint there."""
    spark = stream.sparkSession
    spark.conf.set(*STORE)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
