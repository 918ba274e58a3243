"""Streams in several micro-batches give what the batch operators give, and hold nothing when their sessions are over."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import frames, fusion, resample
from gleaner.operators.fusion import Belief, Rules
from gleaner.streaming import fusion as fused
from gleaner.streaming import resample as clock
from gleaner.streaming import select

SCHEMA = "video int, i int, t double, dhash long, state string"


def captures(n=300):
    """Three videos side by side, one of which pauses for long; times out of order within 2 seconds."""
    rng = np.random.default_rng(5)
    rows, t = [], 0.0
    for k in range(n):
        t += float(rng.choice([0.01, 0.1, 0.9]))
        rows.append((int(k % 3), k, t + (15.0 if k % 3 == 1 and k > n // 2 else 0.0), int(rng.integers(0, 1 << 16)), "board" if k % 4 else "menu"))
    return rows


def stream_of(spark, path, rows, schema, parts=5):
    """A stream of `parts` batches, in order of arrival, and two more far behind the end of all sessions: they let the watermark pass."""
    size = -(-len(rows) // parts)
    rng = np.random.default_rng(1)
    for p in range(parts):
        part = rows[p * size : (p + 1) * size]
        spark.createDataFrame([part[k] for k in rng.permutation(len(part))], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    held = [json.loads(p.json)["stateOperators"][0] for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
    return spark.sql(f"SELECT * FROM {name}").collect(), held


END = (9, 9999, 100_000.0, 0, "menu")


def test_clock_with_its_last_ticks(spark, tmp_path):
    rows = captures()
    df = spark.createDataFrame(rows, SCHEMA)
    stream = stream_of(spark, str(tmp_path / "in"), [*rows, END], SCHEMA)
    got, _ = run(spark, clock.resampled_stream(stream, "video", "i", "t", 4.0, late=30.0), "ticks", tmp_path)
    key = lambda r: (r.video, r.tick, r.i, r.dup, round(r.t_ideal, 9))
    want = sorted(map(key, resample.resampled(df, "video", "i", "t", 4.0).collect()))
    assert sorted(key(r) for r in got if r.video != 9) == want and len(want) > 100


def test_selection_keeps_places_across_batches(spark, tmp_path):
    rows = captures()
    df = spark.createDataFrame(rows, SCHEMA)
    stream = stream_of(spark, str(tmp_path / "in"), [*rows, END], SCHEMA)
    got, _ = run(spark, select.select_stream(stream, "video", "t", 4, late=30.0), "kept", tmp_path)
    want = {(r.video, r.i) for r in frames.select_frames(df, "video", ["t", "i"], 4).collect()}
    assert {(r.video, r.i) for r in got if r.video != 9} == want and 20 < len(want) < 250
    assert got[0].asDict().keys() == {"video", "i", "t", "dhash", "state"}


def test_thinning(spark, tmp_path):
    rows = captures()
    stream = stream_of(spark, str(tmp_path / "in"), [*rows, END], SCHEMA)
    got, _ = run(spark, select.thinned_stream(stream, "video", "t", 1.0, late=30.0), "thin", tmp_path)
    want = frames.thinned(spark.createDataFrame(rows, SCHEMA), "video", ["t", "i"], "t", 1.0).where("kept").collect()
    assert {(r.video, r.i) for r in got if r.video != 9} == {(r.video, r.i) for r in want}


def test_state_ends_with_the_session_and_late_rows_are_counted(spark, tmp_path):
    """One session after another, then a row behind the watermark, and a new session of an old key."""
    path = str(tmp_path / "in")
    rows = [(v, v * 10 + k, 1000.0 + v * 1000.0 + k, 0, "board") for v in range(4) for k in range(10)] + [(0, 500, 1003.5, 0, "board"), (0, 501, 9000.0, 0, "board"), (7, 600, 20_000.0, 0, "board")]
    for part in (rows[:10], rows[10:20], rows[20:30], rows[30:40], rows[40:42], rows[42:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got, held = run(spark, clock.resampled_stream(stream, "video", "i", "t", 1.0, late=5.0, idle=60.0), "ends", tmp_path)
    want = [(v, k, v * 10 + k) for v in range(4) for k in range(10)] + [(0, 0, 501)]
    assert sorted((r.video, r.tick, r.i) for r in got) == sorted(want)
    assert sum(p["numRowsDroppedByWatermark"] for p in held) >= 1
    assert max(p["customMetrics"].get("numRegisteredTimers", 0) for p in held) >= 1
    assert held[-1]["numRowsTotal"] < held[0]["numRowsTotal"] * 3  # of one session, not of all


def test_latch_by_hand():
    rules = Rules(decay=0.0, support=1.0, confident=0.3, flips=2)

    def after(*reads):
        b = Belief()
        for k, (identity, margin) in enumerate(reads):
            b.read(float(k), k, identity, margin, rules)
        return b.card()

    assert after(("unknown", 0.9)) == ("unknown", 0.0, 0.0, False, 0, 1)
    assert after(("A", 0.4), ("B", 0.5)) == ("B", pytest.approx(0.1), 0.5, False, 1, 2)
    assert after(("A", 0.6), ("A", 0.5))[0::3] == ("A", True, 2 - 0) or after(("A", 0.6), ("A", 0.5))[3] is True
    held = after(("A", 0.6), ("A", 0.5), ("B", 2.0))
    assert held[0] == "A" and held[1] == 0.0 and held[3]  # one contrary read does not flip, whatever its weight
    assert after(("A", 1.0), ("B", 0.5), ("A", 0.5), ("B", 0.5))[0] == "A"  # not in a row
    assert after(("A", 1.0), ("B", 0.5), ("B", 0.2), ("unknown", 0.9), ("B", 0.5))[0] == "B"  # the unsure and the abstaining are passed over
    assert after(("A", 1.0), ("B", 0.5), ("C", 0.5), ("B", 0.5))[0] == "A"
    assert after(("A", 1.0), (None, None), ("face_down", 1.0))[0::4] == ("A", 2)


def test_decay_goes_by_time():
    b = Belief()
    rules = Rules(decay=np.log(2) / 10, support=9.0)
    b.read(0.0, 1, "A", 0.8, rules)
    b.read(20.0, 2, "B", 0.3, rules)
    assert b.card()[:3] == ("B", pytest.approx(0.1), pytest.approx(0.3))


def games(n=240):
    rng = np.random.default_rng(8)
    out = []
    for k in range(n):
        game, state = k % 2, rng.choice(["board", "board", "board", "modal"])
        cards = sorted(rng.choice(4, rng.integers(0, 4), replace=False).tolist()) if state == "board" else []
        base = (game, k, 1000.0 + k * 0.5, str(state))
        out += [(*base, s, str(rng.choice([f"id{s}", f"id{s}", "unknown", "idX"])), float(rng.integers(0, 90)) / 100) for s in cards] or [(*base, None, None, None)]
    return out


@pytest.mark.parametrize("length", [20.0, 500.0])
def test_fusion_stream_is_the_batch(spark, tmp_path, length):
    rows = games()
    schema = "game int, frame long, seconds double, state string, slot long, identity string, margin double"
    df = spark.createDataFrame(rows, schema)
    rules = Rules(decay=0.02, support=0.8, confident=0.3, flips=2)
    batch = fusion.fused(df.select("game", "frame", "seconds", "state").distinct(), df.where("slot is not null").select("game", "frame", "slot", "identity", "margin"), "game", length, rules)
    stream = stream_of(spark, str(tmp_path / "in"), [*rows, (9, 99_999, 90_000.0, "menu", None, None, None)], schema)
    got, _ = run(spark, fused.fused_stream(stream, "game", length, rules, late=60.0), f"cards{int(length)}", tmp_path)
    names = [c for c in batch.columns]
    plain = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names)
    want = sorted(map(plain, batch.collect()))
    assert sorted(plain(r) for r in got if r.game != 9) == want and len(want) >= 8
    assert {r.revealed for r in batch.collect()} == {True, False} or length == 500.0
    if length == 20.0:
        assert batch.where("staleness_frames > 0").count() > 0


def test_fusion_of_awkward_rows(spark):
    frame_kind, read_kind = "game int, frame long, seconds double, state string", "game int, frame long, slot long, identity string, margin double"
    none = fusion.fused(spark.createDataFrame([], frame_kind), spark.createDataFrame([], read_kind), "game", 10.0)
    assert none.collect() == []
    f = spark.createDataFrame([(1, 0, 0.0, "board"), (1, 1, 1.0, "modal"), (1, 2, 2.0, None)], frame_kind)
    r = spark.createDataFrame([(1, 0, 0, None, None), (1, 0, 0, None, None), (1, 1, 1, "A", 1.0)], read_kind)
    (row,) = fusion.fused(f, r, "game", 10.0).collect()
    assert (row.identity, row.confidence, row.staleness_frames, row.fused_from, row.last_frame) == ("unknown", 0.0, 2, 1, 2)


def test_a_gap_of_a_year_is_no_long_array(spark):
    year = 365 * 86400.0
    df = spark.createDataFrame([("s", 0, 0.0), ("s", 1, year)], "session string, i int, t double")
    got = resample.resampled(df, "session", "i", "t", 30.0).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max("tick").alias("m")).collect()
    assert sorted((r.i, r.n, r.m) for r in got) == [(0, int(year * 30), int(year * 30) - 1), (1, 1, int(year * 30))]
