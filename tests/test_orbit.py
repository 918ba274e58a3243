"""Last-kept selection in chunks gives what a plain walk gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import frames, orbit
from gleaner.plans.queries import DEDUP_BITS
from gleaner.sources import tables as T


def plain(rows, apart):
    """rows (group, order, value) -> the kept (group, order), one by one."""
    out, last, group = set(), None, object()
    for g, k, v in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1])):
        if g != group or v is None or last is None or apart(v, last):
            out.add((g, k))
            last = v
        group = g
    return out


def bits(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def videos():
    rng = random.Random(4)
    still = [("still", k, 7) for k in range(700)]
    noise = [("noise", k, rng.getrandbits(63)) for k in range(700)]
    # Each hash is 5 bits from the next: every second one is kept, and two orbits never meet.
    drift = [("drift", k, sum(1 << (i % 60) for i in range(5 * k, 5 * k + 5))) for k in range(700)]
    cuts = [(None, k, rng.choice([0, 1, 3, (1 << 40) - 1, -1, None]) if k % 50 == 0 else 3) for k in range(700)]
    return still + noise + drift + cuts + [("one", 0, 5)]


@pytest.mark.parametrize("group_rows", [60, 1000])
def test_dedup_in_chunks(spark, group_rows):
    rows = videos()
    df = spark.createDataFrame(rows, "video string, k long, dhash long").repartition(6)
    got = {(r.video, r.k) for r in frames.dedup_last_kept(df, "video", ["k"], group_rows=group_rows).where("kept").collect()}
    assert got == plain(rows, lambda a, b: bits(a, b) > 8)


def test_orbits_that_never_meet_end_in_one_task(spark):
    """A chunk finds a new orbit in each round: more than are asked for."""
    rng = random.Random(1)
    times, t = [], 0.0
    for k in range(900):
        t += 1.0 + rng.random() * 1e-6
        times.append(("grid", k, t))
    df = spark.createDataFrame(times, "video string, k long, seconds double").repartition(4)
    apart = frames.later(37.5)
    want = plain(times, lambda a, b: a - b >= 37.5)
    for rounds in (0, 1, 60):
        got = {(r.video, r.k) for r in orbit.last_kept(df, "video", ["k"], "seconds", apart, 50, rounds).where("kept").collect()}
        assert got == want


def test_query_rows_in_chunks_and_whole(spark):
    d = "/root/testdata/sf0.01"
    for rows, order, value, apart in ((T.hashes(spark, d), ["vec_id"], "dhash", frames.far(DEDUP_BITS)), (T.captures(spark, d).select("user_id", "event_id", "seconds").withColumn("label", F.lit("all")), ["seconds", "event_id"], "seconds", frames.later(900.0))):
        whole = orbit.last_kept(rows, "label", order, value, apart)
        cut = orbit.last_kept(rows, "label", order, value, apart, 40 if value == "dhash" else 1000)
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_large_group_is_dealt_to_many_tasks(spark):
    """Two million rows of one video: no task walks more than a few chunks."""
    n = 2_000_000
    rows = spark.range(n, numPartitions=8).select(F.lit("v").alias("video"), F.col("id").alias("k"), F.when(F.col("id") % 1000 < 900, F.floor(F.col("id") / 5000)).otherwise(F.xxhash64("id")).alias("dhash"))
    got = frames.dedup_last_kept(rows, "video", ["k"], group_rows=200_000)
    sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect()
    assert sum(r.n for r in sizes) == n and max(r.n for r in sizes) < n // 2
    values = np.array(rows.orderBy("k").select("dhash").toPandas()["dhash"])
    kept, _ = orbit.walked(values, np.zeros(n, bool), None, frames.far(8))
    assert sum(r.kept for r in sizes) == len(kept)


def test_walk_by_windows_is_the_plain_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        values = rng.integers(0, 4, rng.integers(0, 300)) * 255
        null = rng.random(len(values)) < 0.02
        kept, _ = orbit.walked(values, null, None, frames.far(8))
        want = plain([("g", k, None if x else int(v)) for k, (v, x) in enumerate(zip(values, null, strict=True))], lambda a, b: bits(a, b) > 8)
        assert {("g", int(k)) for k in kept} == want


def test_empty(spark):
    assert frames.dedup_last_kept(spark.createDataFrame([], "video string, k long, dhash long"), "video", ["k"]).collect() == []
