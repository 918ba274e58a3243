"""Keyed folds in order of event time, with timers: state ends with its session.

Rows of a key wait until the watermark has passed them, so that a fold sees them in order however
they are spread over micro-batches. A timer stands `idle` seconds after a key's newest row: when the
watermark passes it, what waits is folded, the fold says its last words, and all state of the key
goes. Rows behind the watermark are dropped by Spark, which counts them in the query's progress
(numRowsDroppedByWatermark). Later rows of the same key begin a new session.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that rows may come late, and that a session lives without rows.
LATE, IDLE = 10.0, 60.0
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(Protocol):
    """What is done with a key's rows. State is any plain value; None at the start. Outputs are tuples."""

    def step(self, state: object, row: tuple) -> tuple[object, Iterable[tuple]]: ...

    def end(self, state: object) -> Iterable[tuple]: ...


class _InOrder(StatefulProcessor):
    def __init__(self, columns: list[str], outputs: list[str], fold: Fold, idle: float) -> None:
        self._columns, self._outputs, self._fold, self._idle = columns, outputs, fold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "row binary")
        self._held = handle.getValueState("held", "state binary, newest double")

    def _run(self, rows: list[tuple], state: object, key: tuple, last: bool) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in rows:
            state, said = self._fold.step(state, row)
            out += said
        if last:
            out += self._fold.end(state)
        self._state = state
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=self._outputs)

    def _load(self) -> tuple[list[tuple], object, float]:
        state, newest = self._held.get() if self._held.exists() else (None, float("-inf"))
        return [pickle.loads(r[0]) for r in self._waiting.get()], pickle.loads(state) if state else None, newest

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        waiting, state, newest = self._load()
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        for frame in rows:
            waiting += list(zip(*[frame[c].tolist() for c in self._columns], strict=True))
        waiting.sort()
        newest = max(newest, waiting[-1][0])
        ready = [r for r in waiting if r[0] < passed]
        yield from self._run(ready, state, key, False)
        rest = waiting[len(ready) :]
        self._waiting.put([(pickle.dumps(r),) for r in rest]) if rest else self._waiting.clear()
        self._held.update((pickle.dumps(self._state), newest))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(int((newest + self._idle) * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        waiting, state, _ = self._load()
        yield from self._run(sorted(waiting), state, key, True)
        self._waiting.clear()
        self._held.clear()


def folded(rows: DataFrame, keys: list[str], columns: list[str], fold: Fold, kinds: str, late: float = LATE, idle: float = IDLE) -> DataFrame:
    """(keys..., kinds) of `fold` over the rows of each key, as tuples of `columns`; the first is the time in seconds since 1970, and the others make the order of equal times total. Keys and columns are not null.

    `late`: how far behind the newest row of all another one may be. `idle`: how long after its
    newest row a key's session ends. State lives in RocksDB.
    """
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    seen = rows.select(*keys, *[c for c in columns if c not in keys], F.timestamp_seconds(F.col(columns[0])).alias("_time")).withWatermark("_time", f"{late} seconds")
    types = dict(rows.dtypes)
    outputs = [*keys, *(c.split()[0].strip("`") for c in kinds.split(", "))]
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {kinds}"
    return seen.groupBy(*keys).transformWithStateInPandas(_InOrder(columns, outputs, fold, idle), schema, "Append", "EventTime")
