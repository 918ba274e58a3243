"""Irregular captures on a fixed-rate clock.

A tick shows the latest capture at or before it. Seen from the capture, that is a run of ticks:
those from its own time to just before the next one's. So the as-of join is a `lead` and an
explode, in one shuffle by session, and a capture without a tick is a dropped one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.scan import CHUNK, GROUP_ROWS, has_large_group, in_chunks, neighbour, running

EPS = 1e-9
#: Ticks of one array.
RUN = 1 << 15


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, as a double."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / 1e6


def tick_runs(captures: DataFrame, session: str, order: str, seconds: str, fps: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """captures plus first_tick, last_tick: the run of ticks that show each (last before first: none).

    Tick k is at the session's first capture plus k / fps. The last capture is shown once more if a
    tick falls on it, within EPS. A session of more than `group_rows` captures is cut into chunks.
    """
    at = lambda c: (c - F.col("_epoch")) * fps
    if has_large_group(captures, session, group_rows):
        cut = in_chunks(captures, session, [seconds, order], group_rows)
        first = cut.groupBy(F.col(session).alias("_of")).agg(F.min(seconds).alias("_epoch"))
        df = neighbour(cut, session, [seconds, order], seconds, "_next", ahead=True)
        df = df.join(first, df[session].eqNullSafe(first["_of"])).drop("_of", CHUNK)
    else:
        by = Window.partitionBy(session).orderBy(seconds, order)
        df = captures.withColumn("_epoch", F.min(seconds).over(Window.partitionBy(session))).withColumn("_next", F.lead(seconds).over(by))
    last = F.when(F.col("_next").isNull(), F.floor(at(F.col(seconds)) + EPS)).otherwise(F.ceil(at(F.col("_next")) - EPS) - 1)
    return df.withColumn("first_tick", F.ceil(at(F.col(seconds)) - EPS)).withColumn("last_tick", last).drop("_next")


def resampled(captures: DataFrame, session: str, order: str, seconds: str, fps: float) -> DataFrame:
    """(session, tick, t_ideal, order, dup): one row a tick; `dup` if the same capture was shown by the tick before."""
    return ticks_of(tick_runs(captures, session, order, seconds, fps), session, order, fps)


def ticks_of(runs: DataFrame, session: str, order: str, fps: float) -> DataFrame:
    """Runs (session, order, _epoch, first_tick, last_tick) as rows, one a tick. A run is dealt in pieces of RUN ticks: a gap of a year is no long array."""
    pieces = F.sequence(F.floor(F.col("first_tick") / RUN), F.floor(F.col("last_tick") / RUN))
    cut = runs.where("first_tick <= last_tick").select(session, order, "_epoch", "first_tick", "last_tick", F.explode(pieces).alias("_piece"))
    inside = F.sequence(F.greatest("first_tick", F.col("_piece") * RUN), F.least("last_tick", F.col("_piece") * RUN + RUN - 1))
    return cut.select(session, order, "_epoch", "first_tick", F.explode(inside).alias("tick")).select(
        session, "tick", (F.col("_epoch") + F.col("tick") / fps).alias("t_ideal"), order, (F.col("tick") > F.col("first_tick")).alias("dup")
    )


def dup_counts(captures: DataFrame, session: str, order: str, seconds: str, fps: float) -> DataFrame:
    """(session, dup, n): ticks that show a capture first, and again; from the runs' lengths, no tick is made."""
    runs = tick_runs(captures, session, order, seconds, fps).where("first_tick <= last_tick")
    sums = runs.groupBy(session).agg(F.count(F.lit(1)).alias("first"), F.sum(F.col("last_tick") - F.col("first_tick")).alias("again"))
    pair = lambda dup, n: F.struct(F.lit(dup).alias("dup"), F.col(n).alias("n"))
    return sums.select(session, F.inline(F.array(pair(False, "first"), pair(True, "again")))).where("n > 0")


def dropped(captures: DataFrame, session: str, order: str, seconds: str, fps: float) -> DataFrame:
    """(session, order) of captures that no tick shows."""
    return tick_runs(captures, session, order, seconds, fps).where("first_tick > last_tick").select(session, order)


def segments(captures: DataFrame, session: str, order: list[str], size: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """captures plus `segment`, from 0, new at each change of `size`, and `segment_frame`, from 0 in each. A session of more than `group_rows` captures is cut into chunks."""
    if not has_large_group(captures, session, group_rows):
        by = Window.partitionBy(session).orderBy(*order)
        changed = F.coalesce(F.lag(size).over(by) != F.col(size), F.lit(False)).cast("int")
        df = captures.withColumn("_c", changed).withColumn("segment", F.sum("_c").over(by)).drop("_c")
        return df.withColumn("segment_frame", F.row_number().over(Window.partitionBy(session, "segment").orderBy(*order)) - 1)
    df = neighbour(in_chunks(captures, session, order, group_rows), session, order, size, "_was")
    df = running(df.withColumn("_c", F.coalesce(F.col("_was") != F.col(size), F.lit(False)).cast("int")), session, order, F.col("_c"), "segment")
    df = running(df, session, order, F.lit(1), "_n")
    df = running(df, session, order, F.when(F.col("_c") == 1, F.col("_n")), "_from", largest=True)
    return df.withColumn("segment_frame", (F.col("_n") - F.coalesce("_from", F.lit(1))).cast("int")).drop("_was", "_c", "_n", "_from", CHUNK)


def capture_fps(captures: DataFrame, session: str, seconds: str) -> DataFrame:
    """(session, n, fps): rate over the captured span; null with fewer than two captures or no span."""
    span = F.max(seconds) - F.min(seconds)
    return captures.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) > 1) & (span > 0), F.try_divide(F.count(F.lit(1)) - 1, span)).alias("fps"))


def wall_frame(wall: Column, epoch_wall: Column, fps: Column) -> Column:
    """Frame index of a wall-clock time, rounded half to even."""
    return F.rint((wall - epoch_wall) * fps).cast("long")


def counters(captures: DataFrame, session: str, order: str, seconds: str, fps: float, size: str) -> DataFrame:
    """(session, submitted, encoded, duplicated, cfr_dropped, sizes): `sizes` sorted and distinct."""
    runs = tick_runs(captures, session, order, seconds, fps)
    n = F.greatest(F.col("last_tick") - F.col("first_tick") + 1, F.lit(0))
    return runs.groupBy(session).agg(
        F.count(F.lit(1)).alias("submitted"), F.sum(n).alias("encoded"), F.sum(F.greatest(n - 1, F.lit(0))).alias("duplicated"), F.count_if(n == 0).alias("cfr_dropped"), F.sort_array(F.collect_set(size)).alias("sizes")
    )


def even(size: Column) -> Column:
    return size - size % 2
