"""Last-kept selection: a group's kept rows are the orbit of its first row under `next`.

A row that is kept decides alone which later row is kept next: the first one that is apart from it.
`next` is searched for by arrays, in windows that double. A group of at most GROUP_ROWS rows is
walked by one task. A larger one is cut by range into chunks of about that size:

1. each chunk walks from its own first row, and tells the value it keeps last;
2. what a chunk kept last may enter the next one: a chunk is asked where the walk leaves it for
   each value that its predecessor has answered with so far. Walks coalesce when they keep the same
   row, so a chunk soon has no new answers; the rounds needed are as many as there are orbits that
   never meet, and do not depend on the number of chunks;
3. following the answers from the first chunk gives each chunk the value that truly enters it, and
   all chunks are walked once more, side by side.

Groups whose chunks still find new orbits after ROUNDS rounds are walked in order by one task,
batch by batch: that always ends, in linear time and with one value of state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.durable import written

GROUP_ROWS = 1_000_000
ROUNDS = 8
_WINDOW = 32

#: Which of an array of values are apart from one value.
Apart = Callable[[np.ndarray, object], np.ndarray]


def walked(values: np.ndarray, null: np.ndarray, last: object, apart: Apart) -> tuple[np.ndarray, object]:
    """(places that are kept, the value kept last) from `last` on; None before the first row. A null is kept, and so is what follows it."""
    kept, at, n = [], 0, len(values)
    while at < n:
        if last is not None:
            window = _WINDOW
            while at < n:
                hit = null[at : at + window] | apart(values[at : at + window], last)
                first = int(hit.argmax())
                if hit[first]:
                    at += first
                    break
                at, window = at + len(hit), 2 * window
            if at >= n:
                break
        kept.append(at)
        last = None if null[at] else values[at]
        at += 1
    return np.array(kept, np.int64), last


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), null


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of runs of rows with the same keys."""
    codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
    cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield tuple(batch.column(k)[int(a)].as_py() for k in keys), int(a), int(b)


def _flagged(rows: DataFrame, keys: list[str], value: str, apart: Apart, entry: str | None = None) -> DataFrame:
    """Sorted rows with `kept`, walked by runs of equal keys; from the value in `entry`, else from nothing."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            values, null = _arrays(batch.column(value))
            flags = np.zeros(batch.num_rows, bool)
            for key, a, b in _runs(batch, keys):
                if key != now:
                    now, last = key, batch.column(entry)[a].as_py() if entry else None
                kept, last = walked(values[a:b], null[a:b], last, apart)
                flags[a + kept] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], names=[*batch.schema.names, "kept"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", kept boolean"
    return rows.mapInArrow(walk, schema)


def _answers(rows: DataFrame, by: str, value: str, apart: Apart) -> DataFrame:
    """Sorted rows with `_asked`, an array of values that may enter the chunk -> (by, _chunk, entry, leaves)."""
    kinds = dict(rows.dtypes)
    kind = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[kinds[value]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, lasts, own = None, [], [], None

        def told() -> pa.RecordBatch:
            n = len(asked)
            columns = [pa.array([now[0]] * n, own), pa.array([now[1]] * n, pa.int64()), pa.array(asked, kind), pa.array(lasts, kind)]
            return pa.RecordBatch.from_arrays(columns, names=[by, "_chunk", "entry", "leaves"])

        for batch in batches:
            values, null = _arrays(batch.column(value))
            own = batch.schema.field(by).type
            for key, a, b in _runs(batch, [by, "_chunk"]):
                if key != now:
                    if asked:
                        yield told()
                    now, asked = key, batch.column("_asked")[a].as_py()
                    lasts = list(asked)
                lasts = [walked(values[a:b], null[a:b], x, apart)[1] for x in lasts]
        if asked:
            yield told()

    return rows.mapInArrow(walk, f"`{by}` {kinds[by]}, _chunk long, entry {kinds[value]}, leaves {kinds[value]}")


def _both(a: DataFrame, b: DataFrame, *names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[f"_{n}"])
    return cond


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"_{n}" for n in names})


def _large(rows: DataFrame, by: str, order: list[str], value: str, apart: Apart, n: int, chunk_rows: int, rounds: int) -> DataFrame:
    columns = rows.columns
    cut = rows.repartitionByRange(max(2, -(-n // chunk_rows)), by, *order).sortWithinPartitions(by, *order).withColumn("_chunk", F.spark_partition_id().cast("long"))
    rows = written(_flagged(cut, [by, "_chunk"], value, apart).withColumnRenamed("kept", "_own"))
    ends = rows.where("_own").groupBy(by, "_chunk").agg(F.max_by(value, F.struct(*order)).alias("leaves"))
    chunks = written(ends.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy("_chunk"))))
    nothing = F.lit(None).cast(dict(rows.dtypes)[value])
    answers = chunks.select(by, "_chunk", "_at", nothing.alias("entry"), "leaves")
    in_order = lambda df: df.repartition(by, "_chunk").sortWithinPartitions(by, "_chunk", *order)

    def asked_now(known: DataFrame) -> DataFrame:
        """(by, at, entry): what the answers so far say may enter a chunk, and has not been asked."""
        enters = known.select(by, (F.col("_at") + 1).alias("_at"), F.col("leaves").alias("entry")).distinct()
        had = known.select(F.col(by).alias("b"), F.col("_at").alias("a"), F.col("entry").alias("e"))
        new = enters.join(had, F.col(by).eqNullSafe(F.col("b")) & (F.col("_at") == F.col("a")) & F.col("entry").eqNullSafe(F.col("e")), "left_anti")
        at = chunks.select(F.col(by).alias("b"), F.col("_at").alias("a"), "_chunk")
        return new.join(at, F.col(by).eqNullSafe(F.col("b")) & (F.col("_at") == F.col("a"))).select(by, "_chunk", "_at", "entry")

    slim = rows.select(by, "_chunk", *order, *([value] if value not in order else []))
    asks = written(asked_now(answers))
    for _ in range(rounds):
        if asks.isEmpty():
            break
        per = asks.groupBy(F.col(by).alias(f"_{by}"), F.col("_chunk").alias("__chunk"), "_at").agg(F.collect_list("entry").alias("_asked"))
        told = _answers(in_order(slim.join(per, _both(slim, per, by, "_chunk")).drop(f"_{by}", "__chunk", "_at")), by, value, apart)
        where = _keyed(chunks.select(by, "_chunk", "_at"), by, "_chunk")
        answers = written(answers.unionByName(told.join(where, _both(told, where, by, "_chunk")).select(by, "_chunk", "_at", "entry", "leaves")))
        asks = written(asked_now(answers))

    kinds = dict(rows.dtypes)

    def followed(group: pa.Table) -> pa.Table:
        """From the first chunk on, what truly enters each; a group stops where nothing is known. As many rows as the group has chunks and orbits."""
        known: dict[int, dict] = {}
        for row in group.to_pylist():
            known.setdefault(row["_at"], {"chunk": row["_chunk"]})[row["entry"],] = row["leaves"]
        chunks, entries, now = [], [], None
        while len(chunks) + 1 in known and (now,) in known[len(chunks) + 1]:
            here = known[len(chunks) + 1]
            chunks.append(here["chunk"])
            entries.append(now)
            now = here[now,]
        schema = group.schema
        return pa.table({by: group.column(by).slice(0, 1).combine_chunks().take(pa.array([0] * len(chunks))), "_chunk": pa.array(chunks, pa.int64()), "entry": pa.array(entries, schema.field("entry").type)})

    truth = written(answers.groupBy(by).applyInArrow(followed, f"`{by}` {kinds[by]}, _chunk long, entry {kinds[value]}"))
    settled = truth.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(chunks.groupBy(F.col(by).alias("b")).agg(F.count(F.lit(1)).alias("all")), F.col(by).eqNullSafe(F.col("b"))).where("n = all").select(by)
    truth = _keyed(truth.join(_keyed(settled, by), F.col(by).eqNullSafe(F.col(f"_{by}")), "left_semi"), by, "_chunk")
    known = rows.join(truth, _both(rows, truth, by, "_chunk")).select(*columns, "_chunk", "entry")
    out = _flagged(in_order(known), [by, "_chunk"], value, apart, "entry").select(*columns, "kept")
    settled = _keyed(settled, by)
    rest = rows.join(settled, _both(rows, settled, by), "left_anti").select(*columns)
    return out.unionByName(_in_one_task(rest, by, order, value, apart))


def _in_one_task(rows: DataFrame, by: str, order: list[str], value: str, apart: Apart) -> DataFrame:
    return _flagged(rows.repartition(by).sortWithinPartitions(by, *order), [by], value, apart)


def last_kept(rows: DataFrame, by: str, order: list[str], value: str, apart: Apart, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """`rows` with `kept`: whether a row of a group is the first in order, or apart from the last row kept, or one of the two is null.

    `order` must be total within a group. `value` is a long, int or double (NaN is apart from
    nothing). A null group is a group. All columns of `rows` travel: pass slim rows. No rows: none.
    """
    rows = rows.drop("kept")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    large = _keyed(written(counts), by)
    n = large.agg(F.sum("n")).first()[0]
    if not n:
        return _in_one_task(rows, by, order, value, apart)
    named = large.select(f"_{by}")
    small = _in_one_task(rows.join(named, _both(rows, named, by), "left_anti"), by, order, value, apart)
    return small.unionByName(_large(rows.join(named, _both(rows, named, by), "left_semi"), by, order, value, apart, n, group_rows, rounds))
