"""Exact cases of the frame operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import scalar
from gleaner.operators import boxes, catalog, frames, identify, pixels, resample, vectors
from gleaner.plans import pipeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("fps", "target", "stride"), [(30, 1.5, 20), (60, 1.5, 40), (24, 1.5, 16), (30, 2, 15), (25, 1, 25), (1, 1.5, 1), (0.5, 1.5, 1)])
def test_stride(spark, fps, target, stride):
    assert one(spark, scalar.stride_for_fps(F.lit(float(fps)), F.lit(float(target)))) == stride


def test_stride_needs_positive_rates(spark):
    with pytest.raises(Exception, match="positive"):
        one(spark, scalar.stride_for_fps(F.lit(0.0), F.lit(1.5)))


@pytest.mark.parametrize(("a", "b", "bits"), [(0, 0, 0), (0, 15, 4), (10, 5, 4), (8, 0, 1), (0, -1, 64)])
def test_hamming(spark, a, b, bits):
    assert one(spark, scalar.hamming(F.lit(a).cast("long"), F.lit(b).cast("long"))) == bits


@pytest.mark.parametrize(("hashes", "kept"), [([0xABCD] * 4, [0]), ([0, -1, 0], [0, 1, 2]), ([0, 1, 3, 7, 15], [0]), ([0, 0x1FF, 0x3FF, 0], [0, 1, 3])])
def test_dedup(spark, hashes, kept):
    df = spark.createDataFrame([("v", k, h) for k, h in enumerate(hashes)], "video string, i int, dhash long")
    rows = frames.dedup_last_kept(df, "video", ["i"]).where("kept").collect()
    assert sorted(r["i"] for r in rows) == kept


def test_dedup_replay(spark):
    rng = np.random.default_rng(3)
    rows = [(int(v), k, int(rng.integers(0, 1 << 20))) for v in range(4) for k in range(60)]
    got = {(r["video"], r["i"]) for r in frames.dedup_last_kept(spark.createDataFrame(rows, "video int, i int, dhash long"), "video", ["i"]).where("kept").collect()}
    want, last = set(), {}
    for v, k, h in rows:
        if v not in last or (last[v] ^ h).bit_count() > frames.NEAR_BITS:
            last[v] = h
            want.add((v, k))
    assert got == want


def test_menu_frames_anchor(spark):
    rows = [("v", 0, 0, "board"), ("v", 1, 0xFFFF, "menu"), ("v", 2, 0xFFFF, "board"), ("v", 3, 0, "board")]
    out = frames.select_frames(spark.createDataFrame(rows, "video string, i int, dhash long, state string"), "video", ["i"]).collect()
    assert sorted(r["i"] for r in out) == [0, 3]


@pytest.mark.parametrize(("box", "keep"), [
    ((0.05, 0.05, 0.10, 0.10), False), ((0.90, 0.10, 0.08, 0.12), False), ((0.16, 0.58, 0.05, 0.12), False), ((0.79, 0.20, 0.05, 0.15), False), ((0.845, 0.05, 0.05, 0.10), False),
    ((0.30, 0.30, 0.12, 0.16), True), ((0.65, 0.25, 0.12, 0.16), True), ((0.46, 0.06, 0.12, 0.20), True), ((0.46, 0.25, 0.10, 0.15), True),
])
def test_zones(spark, box, keep):
    df = spark.createDataFrame([box], "x double, y double, w double, h double")
    assert bool(boxes.outside_zones(df).count()) is keep


def test_crop_edges(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4), (0.9, 0.9, 0.5, 0.5)], "x double, y double, w double, h double")
    a, b = boxes.crop(df, F.lit(200), F.lit(100)).collect()
    assert (a["x0"], a["y0"], a["x1"], a["y1"], a["empty"]) == (20, 20, 80, 60, False)
    assert (b["x1"], b["y1"]) == (200, 100)


def test_suppression_keeps_the_larger(spark):
    rows = [(1, 1, 0.1, 0.1, 0.2, 0.2), (1, 2, 0.11, 0.11, 0.19, 0.19), (1, 3, 0.6, 0.6, 0.1, 0.1)]
    out = boxes.suppressed(spark.createDataFrame(rows, "f int, id int, x double, y double, w double, h double"), "f", "id").collect()
    assert sorted((r["slot"], r["id"]) for r in out) == [(0, 1), (1, 3)]


def test_gate(spark):
    case = lambda m, c, r: one(spark, frames.gate(F.lit(m), F.lit(c), F.lit(r)))
    assert [case(170.0, 1.0, 1.0), case(100.0, 90.0, 30.0), case(100.0, 90.0, 80.0), case(100.0, float("nan"), 1.0), case(100.0, 5.0, 0.0)] == ["menu", "modal", "board", "board", "board"]


def test_ensemble(spark):
    c = [(1, "Moss", "villager", 0.40), (2, "Fern", "minion", 0.91), (3, "unknown", "unknown", 0.0), (4, "Moss", "villager", 0.52), (5, "Iris", "minion", 0.43), (6, "unknown", "unknown", 0.1), (8, "Ash", None, 0.5)]
    e = [(1, "Moss", "demon", 0.35), (2, "Fern", "demon", 0.97), (3, "Fern", "outcast", 0.31), (4, "unknown", "unknown", 0.0), (5, "Ember", "demon", 0.22), (7, "Lark", "villager", 0.4)]
    kind = "k int, identity string, role string, confidence double"
    out = {r["k"]: (r["identity"], r["role"], r["confidence"], r["source"]) for r in identify.combined(*[spark.createDataFrame(x, kind) for x in (c, e)], "k").collect()}
    assert out == {
        1: ("Moss", "villager", 0.55, "agree"), 2: ("Fern", "minion", 1.0, "agree"), 3: ("Fern", "outcast", 0.31, "embedding_only"), 4: ("Moss", "villager", 0.52, "classical_only"),
        5: ("unknown", "unknown", 0.0, "disagree_abstain"), 6: ("unknown", "unknown", 0.0, "both_unknown"), 7: ("Lark", "villager", 0.4, "embedding_only"), 8: ("Ash", "unknown", 0.5, "classical_only"),
    }


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_equal_scores_go_to_the_lower_reference(spark, limit):
    """By number, not by text: 9 comes before 10."""
    refs = spark.createDataFrame([(k, [1.0, 0.0] if k in (9, 10, 30) else [0.0, 1.0]) for k in (30, 10, 9, 2)], "entry int, v array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    got = {r.id: (r.best, r.second) for r in vectors.two_best(rows, ["id"], "v", refs, "entry", "v", limit=limit).collect()}
    assert got == {1: ("9", "10"), 2: ("2", "9")}


def test_slugs(spark):
    slug = lambda t: one(spark, scalar.slugify(F.lit(t)))
    assert [slug("\tA b\n"), slug("\u2003x y\xa0"), slug("a\tb c"), slug("é.png"), slug("")] == ["A_b", "x_y", "a_b_c", "_.png", ""]


@pytest.mark.parametrize(("conf", "tinted", "want"), [(0.80, True, ("A", "demon", 0.56)), (0.55, True, ("unknown", "unknown", 0.385)), (0.9, True, ("A", "demon", 0.63)), (0.2, False, ("A", "demon", 0.2))])
def test_tint(spark, conf, tinted, want):
    i, r, c = identify.tint_discounted(F.lit("A"), F.lit("demon"), F.lit(conf), F.lit(tinted))
    assert tuple(spark.range(1).select(i, r, c).first()) == want


def test_prototype_edge_cases(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [-1.0, 0.0]), (3, "b", [0.0, 2.0])], "id int, label string, embedding array<double>")
    protos = vectors.prototypes(v, ["label"])
    assert [r["label"] for r in protos.collect()] == ["b"]
    assert {r["identity"] for r in vectors.nearest(v, protos, ["id"]).collect()} == {"unknown"}


def test_resampler_counts(spark):
    # 2 s at 60 a second onto a clock of 30: 61 ticks, none shown twice; a gap of 1 s shows its last frame 29 more times.
    df = spark.createDataFrame([(1, k, k / 60) for k in range(121)], "s int, i int, t double")
    rows = resample.resampled(df, "s", "i", "t", 30).collect()
    assert (len(rows), sum(r["dup"] for r in rows)) == (61, 0)
    gap = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0)], "s int, i int, t double")
    assert sum(r["dup"] for r in resample.resampled(gap, "s", "i", "t", 30).collect()) == 29


def test_file_names(spark):
    stems = ["Sample1_003_t00460s", "clip", "a_x_t1.5s", "a_2_tts"]
    v, i, t = scalar.frame_name(F.col("s"))
    got = [tuple(r) for r in spark.createDataFrame([(s,) for s in stems], "s string").select(v, i, t).collect()]
    assert got == [("Sample1", 3, 460.0), ("clip", 0, 0.0), ("a", 0, 1.5), ("a", 2, 0.0)]


def test_snapshot_json(spark, tmp_path):
    f = spark.createDataFrame([(1, "board", 10, 20), (2, "menu", 10, 20)], "f int, state string, w int, h int")
    c = spark.createDataFrame([(1, 0, "A", "demon", 0.91, 0.1, 0.2, 0.3, 0.4), (2, 0, "B", "x", 0.5, 0.0, 0.0, 0.1, 0.1)], "f int, slot int, identity string, role string, confidence double, x double, y double, w double, h double")
    s = catalog.snapshots(f, c, "f")
    catalog.write_snapshots(s, str(tmp_path / "out"))
    back = {r["f"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back[1]["cards"][0]["bbox_rel"] == [0.1, 0.2, 0.3, 0.4] and back[2]["cards"] == []


def test_blob_is_found(spark):
    image = np.zeros((360, 640, 3), np.uint8)
    image[108:166, 192:269] = (0, 200, 0)
    rows = [(1, "board", 640, 360, bytearray(image.tobytes())), (2, "menu", 640, 360, bytearray(image.tobytes())), (3, "board", 640, 360, bytearray(np.zeros_like(image).tobytes()))]
    out = {r["frame"]: r["cards"] for r in pipeline.run(spark.createDataFrame(rows, "frame int, state string, w int, h int, pixels binary")).collect()}
    assert [len(out[k]) for k in (1, 2, 3)] == [1, 0, 0]
    x, y, w, h = out[1][0]["bbox_rel"]
    assert abs(x - 0.3) < 0.02 and abs(y - 0.3) < 0.02 and abs(w - 0.12) < 0.02 and abs(h - 0.16) < 0.02


def test_components_touching_corners():
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 3] = True
    assert pixels.component_boxes(mask) == [(0, 0, 2, 2), (3, 4, 1, 1)]


def test_thumbnail_of_constant():
    assert np.allclose(pixels.thumbnail_cells(np.full((48, 64, 3), 77, np.uint8)), 77)
