"""Frame selection on an unbounded stream: one value of state a video, until the video is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.frames import NEAR_BITS, far, later
from gleaner.operators.orbit import Apart
from gleaner.streaming.ordered import IDLE, LATE, folded


class _Kept:
    """State: the value kept last, in a tuple."""

    def __init__(self, value: int, apart: Apart) -> None:
        self._value, self._apart = value, apart

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        v = row[self._value]
        return ((v,), [row]) if state is None or self._apart(v, state[0]) else (state, [])

    def end(self, state: tuple | None) -> list[tuple]:
        return []


def kept_stream(rows: DataFrame, by: str, seconds: str, value: str, apart: Apart, late: float = LATE, idle: float = IDLE) -> DataFrame:
    """Rows that are the first of their group in order of time or apart from the last one kept; all columns of `rows`, none of them null.

    `seconds`: the event time, seconds since 1970. Rows wait until the watermark has passed them, so
    that frames which come in a later batch than their successors keep their place.
    """
    kinds = dict(rows.dtypes)
    columns = [seconds, *(c for c in rows.columns if c not in (seconds, by))]
    found = folded(rows, [by], columns, _Kept(columns.index(value), apart), ", ".join(f"`{c}` {kinds[c]}" for c in columns), late, idle)
    return found.select(*rows.columns)


def select_stream(frames: DataFrame, by: str, seconds: str, threshold: int = NEAR_BITS, state: str = "board", late: float = LATE, idle: float = IDLE) -> DataFrame:
    """Frames (by, seconds, dhash, state, ...) that are over `threshold` bits from the last kept one of any state, and in `state`."""
    return kept_stream(frames, by, seconds, "dhash", far(threshold), late, idle).where(F.col("state") == state)


def thinned_stream(rows: DataFrame, by: str, seconds: str, max_fps: float, late: float = LATE, idle: float = IDLE) -> DataFrame:
    """Rows at least 1 / max_fps after the last kept one of their group."""
    return kept_stream(rows, by, seconds, seconds, later(1.0 / max_fps), late, idle)
