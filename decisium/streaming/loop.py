"""Control-loop state over a stream: what the batch windows of
operators.timeseries give, kept by key in the state store.

Keys are many and have few steps each, so a key's steps come and go as rows,
without a data frame a key, and it asks the state store for little: its value,
and its timer only when that moves.

A key's state is small and bounded: the last k actions, the last values of the
mean, the last position, and order and time of the last step. It goes on over
micro-batches and restarts from a checkpoint. A step more than `idle` seconds
after the one before starts anew, as a new episode, named by the time of its
first step in microseconds; a timer of event time drops the state of keys that
the watermark has left that far behind, which changes no result. Steps before a
key's last one come too late: they are given with `late`
and change nothing. Null actions count as actions; a null key is a key."""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: Columns of steps: key, step (order of equal times), ts, action, value, x, y.
OUT = "key string, step long, episode long, history array<string>, stuck boolean, moving double, late boolean"
_step = Row(*[c.split()[0] for c in OUT.split(", ")])
STATE = StructType(
    [
        StructField("actions", ArrayType(StringType())),
        StructField("values", ArrayType(DoubleType())),
        StructField("place", ArrayType(DoubleType())),
        StructField("micros", LongType()),
        StructField("step", LongType()),
        StructField("episode", LongType()),
    ]
)


class Loop(StatefulProcessor):
    """Ring buffers of one key."""

    def __init__(self, moves: list[str], k: int, mean_of: int, idle: int):
        self.moves, self.k, self.mean_of, self.idle = set(moves), k, mean_of, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("loop", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        steps = sorted(rows, key=lambda r: (r.micros, r.step))
        old = self.kept.get()  # none if there is no state
        actions, values = deque(old[0] if old else [], self.k), deque(old[1] if old else [], self.mean_of)
        place, last, episode = (list(old[2]) if old[2] is not None else None, (old[3], old[4]), old[5]) if old else (None, None, None)
        for row in steps:
            micros, step, action = row.micros, row.step, row.action
            value, here = _number(row.value), [_number(row.x), _number(row.y)]
            if last is not None and (micros, step) < last:
                yield _step(key[0], step, episode, list(actions), False, None, True)
                continue
            if last is None or micros - last[0] > self.idle * 1_000_000:
                actions.clear()
                values.clear()
                place, episode = None, micros
            stuck = place is not None and None not in here and here == place and bool(actions) and actions[-1] in self.moves
            values.append(value)
            seen = [v for v in values if v is not None]
            yield _step(key[0], step, episode, list(actions), stuck, sum(seen) / len(seen) if seen else None, False)
            actions.append(action)
            place, last = None if None in here else here, (micros, step)
        if last is not None and (old is None or last != (old[3], old[4])):
            self.kept.update((list(actions), list(values), place, last[0], last[1], episode))
            due = self._due(last[0])
            if old is None or due != self._due(old[3]):
                if old is not None:  # the key's only timer
                    self.handle.deleteTimer(self._due(old[3]))
                self.handle.registerTimer(due)

    def _due(self, micros: int) -> int:
        return micros // 1000 + self.idle * 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def loop_stream(steps: DataFrame, moves: list[str], k: int = 4, mean_of: int = 20, idle: int = 86400, delay: str = "0 seconds") -> DataFrame:
    """OUT of a stream of steps (key, step, ts, action, value, x, y)."""
    timed = steps.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select(F.col("key").cast("string").alias("key"), F.col("step").cast("long").alias("step"), "ts", F.unix_micros("ts").alias("micros"), "action", F.col("value").cast("double").alias("value"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.groupBy("key").transformWithState(Loop(moves, k, mean_of, idle), OUT, "Append", "EventTime")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, while a query starts and runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
