"""Ordered scans in two levels: a group's rows are cut by range into chunks, and chunks hand on what the next one needs.

A window over a group is one task's. Where a group is larger than GROUP_ROWS, all rows are cut by
range of group and order: windows are then over chunks, and what crosses their edges (a neighbour, a
running value) comes from a table of one row a group and chunk. Smaller groups need no cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.durable import written

GROUP_ROWS = 1_000_000
CHUNK = "_chunk"


def has_large_group(rows: DataFrame, group: str, group_rows: int = GROUP_ROWS) -> bool:
    return not rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).isEmpty()


def in_chunks(rows: DataFrame, group: str, order: list[str], chunk_rows: int = GROUP_ROWS) -> DataFrame:
    """`rows` with their chunk, in a table of its own. `order` must be total within a group."""
    n = max(2, -(-rows.count() // chunk_rows))
    return written(rows.repartitionByRange(n, group, *order).withColumn(CHUNK, F.spark_partition_id()))


def _with(rows: DataFrame, group: str, edges: DataFrame) -> DataFrame:
    """`rows` with the columns of `edges` (group, chunk, ...)."""
    edges = edges.withColumnsRenamed({group: "_of", CHUNK: "_at"})
    return rows.join(edges, rows[group].eqNullSafe(edges["_of"]) & (rows[CHUNK] == edges["_at"])).drop("_of", "_at")


def neighbour(rows: DataFrame, group: str, order: list[str], value: str, name: str, ahead: bool = False) -> DataFrame:
    """Chunked `rows` with `name`: the group's value one row before, or ahead."""
    key = F.struct(*order)
    ends = rows.groupBy(group, CHUNK).agg((F.min_by if ahead else F.max_by)(value, key).alias("_end"))
    by_chunk = Window.partitionBy(group).orderBy(CHUNK)
    edges = ends.select(group, CHUNK, (F.lead if ahead else F.lag)("_end").over(by_chunk).alias("_beyond"))
    w = Window.partitionBy(group, CHUNK).orderBy(*order)
    step = F.lead if ahead else F.lag
    edge = step(F.lit(1)).over(w).isNull()
    return _with(rows, group, edges).withColumn(name, F.when(edge, F.col("_beyond")).otherwise(step(value).over(w))).drop("_beyond")


def running(rows: DataFrame, group: str, order: list[str], amount: Column, name: str, largest: bool = False) -> DataFrame:
    """Chunked `rows` with `name`: the sum, or the largest, of `amount` over the group's rows so far; a sum of nulls is 0."""
    f = F.max if largest else F.sum
    rows = rows.withColumn("_amount", amount)
    so_far = Window.partitionBy(group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(group, CHUNK).agg(f("_amount").alias("_total")).select(group, CHUNK, f("_total").over(so_far).alias("_before"))
    own = f("_amount").over(Window.partitionBy(group, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    value = F.greatest("_before", own) if largest else F.coalesce("_before", F.lit(0)) + F.coalesce(own, F.lit(0))
    return _with(rows, group, edges).withColumn(name, value).drop("_before", "_amount")
