"""Two-level scans give what plain windows give; pictures hash as an area resize does."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import catalog, frames, resample, scan


def rows():
    rng = random.Random(3)
    out, t = [], 0.0
    for k in range(900):
        t += rng.choice([0.0, 0.1, 0.5, 3.0])
        out.append((rng.choice(["hot", "hot", "hot", "cold", None]), k, t, rng.choice(["a", "a", "a", "b", None])))
    return out


KIND = "session string, i int, t double, size string"


@pytest.mark.parametrize("limit", [40, 300])
def test_segments_in_chunks(spark, limit):
    df = spark.createDataFrame(rows(), KIND).repartition(5)
    plain, cut = (resample.segments(df, "session", ["t", "i"], "size", n) for n in (10_000, limit))
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(*plain.columns).collect()))
    assert scan.in_chunks(df, "session", ["t", "i"], limit).groupBy("session").agg(F.countDistinct("_chunk").alias("n")).agg(F.max("n")).first()[0] >= 2


@pytest.mark.parametrize("limit", [40, 300])
def test_ticks_in_chunks(spark, limit):
    df = spark.createDataFrame([r for r in rows() if r[0]], KIND).repartition(5)
    plain, cut = (resample.tick_runs(df, "session", "i", "t", 4.0, n).select("session", "i", "_epoch", "first_tick", "last_tick") for n in (10_000, limit))
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_batches_in_chunks(spark):
    df = spark.range(1000).select(F.col("id").alias("title"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g")).repartition(4)
    assert sorted(map(str, catalog.batches(df, "title", "g").collect())) == sorted(map(str, catalog.batches(df, "title", "g", group_rows=60).collect()))


def test_a_row_of_one_value_each(spark):
    """Ends of chunks with null values, and chunks of a single row."""
    df = spark.createDataFrame([("g", k, None if k % 3 else k) for k in range(30)], "g string, k int, v int")
    cut = scan.in_chunks(df, "g", ["k"], 2)
    got = {r.k: (r.was, r.next, r.sum, r.top) for r in scan.running(scan.running(scan.neighbour(scan.neighbour(cut, "g", ["k"], "v", "was"), "g", ["k"], "v", "next", ahead=True), "g", ["k"], F.col("v"), "sum"), "g", ["k"], F.col("v"), "top", largest=True).collect()}
    v = [None if k % 3 else k for k in range(30)]
    for k in range(30):
        assert got[k] == (v[k - 1] if k else None, v[k + 1] if k < 29 else None, sum(x or 0 for x in v[: k + 1]), max(x for x in v[: k + 1] if x is not None))


@pytest.mark.parametrize(("w", "h"), [(9, 8), (13, 11), (40, 24), (5, 3)])
def test_picture_hash_is_of_an_area_resize(spark, w, h):
    rng = np.random.default_rng(w)
    images = rng.integers(0, 255, (3, h, w))
    images[2] = 7
    df = spark.createDataFrame([(n, x, y, int(images[n, y, x])) for n in range(3) for y in range(h) for x in range(w)] + [(0, w, 0, 255), (0, 0, 0, None)], "picture int, x int, y int, v int").repartition(3)
    got = {r.picture: r.dhash for r in frames.picture_hashes(df, "picture", F.lit(w), F.lit(h)).collect()}
    for n in range(3):
        big = np.kron(images[n], np.ones((8, 9)))  # each cell is w x h of these whole numbers
        cells = big.reshape(8, h, 9, w).sum(axis=(1, 3))
        bits = (cells[:, 1:] > cells[:, :-1]).ravel()
        assert got[n] & (1 << 64) - 1 == int("".join("1" if b else "0" for b in bits), 2)
    assert got[2] == 0
