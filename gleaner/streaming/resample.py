"""Captures on a fixed-rate clock, as a stream: a tick is out once the capture after it has come, the last ones when the session ends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from gleaner.operators.resample import EPS, ticks_of
from gleaner.streaming.ordered import IDLE, LATE, folded


class _Runs:
    """State: the session's first time, the latest capture's time and name."""

    def __init__(self, fps: float) -> None:
        self._fps = fps

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        seconds, name = row
        if state is None:
            return (seconds, seconds, name), []
        epoch, last, shown = state
        first, end = math.ceil((last - epoch) * self._fps - EPS), math.ceil((seconds - epoch) * self._fps - EPS)
        return (epoch, seconds, name), [(epoch, first, end - 1, shown)] if first < end else []

    def end(self, state: tuple | None) -> list[tuple]:
        if state is None:
            return []
        epoch, last, shown = state
        first, final = math.ceil((last - epoch) * self._fps - EPS), math.floor((last - epoch) * self._fps + EPS)
        return [(epoch, first, final, shown)] if first <= final else []


def resampled_stream(captures: DataFrame, session: str, order: str, seconds: str, fps: float, late: float = LATE, idle: float = IDLE) -> DataFrame:
    """(session, tick, t_ideal, order, dup) as `resample.resampled` gives, the last capture's ticks with it.

    A session ends when the watermark (`late` seconds behind the newest capture of all) is `idle`
    seconds past its newest capture; nothing is held of it then. Captures later than `late` are
    dropped, and counted in the query's progress.
    """
    runs = folded(captures, [session], [seconds, order], _Runs(fps), f"_epoch double, first_tick long, last_tick long, `{order}` {dict(captures.dtypes)[order]}", late, idle)
    return ticks_of(runs, session, order, fps)
