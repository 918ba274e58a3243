"""The composed frame pipeline, its parts, sources and sinks."""

import json
import struct
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import scalar
from gleaner.operators import catalog, frames, pixels, resample, vectors
from gleaner.plans import config, pipeline
from gleaner.sources import images

GREEN, PURPLE, RED = (0, 200, 0), (200, 0, 100), (0, 0, 200)


def write_png(path, image):
    """A picture of red-green-blue(-alpha) values as PNG."""
    h, w, c = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def frame_bytes(*cards, background=100, w=640, h=360):
    image = np.full((h, w, 3), background, np.uint8)
    for x, y, cw, ch, colour in cards:
        image[y : y + ch, x : x + cw] = colour
    return bytearray(image.tobytes())


@pytest.fixture(scope="module")
def shots(spark):
    rows = [
        (1, frame_bytes((192, 108, 77, 58, GREEN), (320, 108, 77, 58, PURPLE))), (2, frame_bytes(background=230)), (3, frame_bytes((192, 108, 256, 144, (250, 250, 250)), background=20)), (4, frame_bytes()),
        (5, frame_bytes((192, 108, 77, 58, GREEN), (0, 0, 640, 30, (0, 0, 255)), (0, 330, 640, 30, (0, 0, 255)))),
    ]
    return spark.createDataFrame([(k, 640, 360, x) for k, x in rows], "frame int, w int, h int, pixels binary")


@pytest.fixture(scope="module")
def pictures(spark):
    plain = lambda colour: bytearray(np.full((20, 20, 3), colour, np.uint8).tobytes())
    return spark.createDataFrame([("g", "Moss", "villager", 20, 20, plain(GREEN)), ("p", "Iris", "minion", 20, 20, plain(PURPLE))], "entry string, identity string, role string, w int, h int, pixels binary")


def cards_of(records):
    return {r["frame"]: (r["frame_state"], [(c["slot"], c["identity"], c["role_class"], round(c["confidence"], 4)) for c in r["cards"]]) for r in records.collect()}


def by_mean(crops):
    """An embedder: the mean colour of a crop."""

    def means(batches):
        for b in batches:
            yield b.assign(embedding=[(np.frombuffer(x, np.uint8).reshape(-1, 3).mean(axis=0) / 255).tolist() for x in b["crop"]])

    return crops.mapInPandas(means, ", ".join(f"{c} {k}" for c, k in crops.dtypes) + ", embedding array<double>")


def test_composed_pipeline(spark, shots, pictures):
    classical = pipeline.classical_identifier(pictures)
    got = cards_of(pipeline.run(shots, identifier=classical))
    # 5 is tinted: 1.0 times 0.7.
    assert got == {1: ("board", [(0, "Moss", "villager", 1.0), (1, "Iris", "minion", 1.0)]), 2: ("menu", []), 3: ("modal", []), 4: ("board", []), 5: ("board", [(0, "Moss", "villager", 0.7)])}
    assert cards_of(pipeline.run(shots, identifier=classical, discount=False))[5][1][0][3] == 1.0
    assert cards_of(pipeline.run(shots))[1][1] == [(0, "unknown", "unknown", 0.0), (1, "unknown", "unknown", 0.0)]
    assert all(not cards for _, cards in cards_of(pipeline.run(shots, localizer=pipeline.nothing_localized)).values())


def test_identifiers_by_factory(spark, shots, pictures):
    protos = spark.createDataFrame([("Moss", "villager", [0.0, 1.0, 0.0]), ("Iris", "minion", [0.9, 0.0, 0.44])], "identity string, role string, proto array<double>")
    classical, embedding = (lambda: pipeline.classical_identifier(pictures)), (lambda: pipeline.embedding_identifier(protos, by_mean))
    one = shots.where("frame = 1")
    names = lambda f: [(c[1], c[2]) for c in cards_of(pipeline.run(one, identifier=f))[1][1]]
    for name in config.IDENTIFIERS:
        assert names(pipeline.chosen_identifier(name, classical, embedding)) == [("Moss", "villager"), ("Iris", "minion")]
    both = cards_of(pipeline.run(one, identifier=pipeline.chosen_identifier("ensemble", classical, embedding)))[1][1]
    assert both[0][3] == 1.0
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert names(pipeline.chosen_identifier("ensemble", classical, None)) == [("Moss", "villager"), ("Iris", "minion")]
    assert any("classical" in str(w.message) for w in told)


def test_close_matches_go_by_keypoints(spark, pictures):
    crops = spark.createDataFrame([(1, 0, 20, 20, bytearray(np.full((20, 20, 3), GREEN, np.uint8).tobytes())), (1, 1, 8, 8, bytearray(bytes(192))), (1, 2, 0, 0, None)], "frame int, slot int, crop_w int, crop_h int, crop binary")
    twin = pictures.where("entry = 'g'").unionByName(pictures.where("entry = 'g'").withColumn("entry", F.lit("a")).withColumn("identity", F.lit("Fern")))
    near = spark.createDataFrame([(1, 0, k << 20) for k in range(6)], "frame int, slot int, hash long")
    far = spark.createDataFrame([("g", k << 20) for k in range(6)] + [("g", -1), ("a", -1), ("a", -2)], "entry string, hash long")
    plain = {r["slot"]: r["identity"] for r in pipeline.classical_identifier(twin)(crops).collect()}
    assert plain == {0: "Fern", 1: "unknown", 2: "unknown"}
    keyed = {r["slot"]: r["identity"] for r in pipeline.classical_identifier(twin, "frame", near, far)(crops).collect()}
    assert keyed == {0: "Moss", 1: "unknown", 2: "unknown"}


def test_gallery_pictures_are_measured_whole(spark):
    """Only the crop is cut to its art band: a reference that is mostly of the crop's colour wins over one that is so in its band."""
    moss, ember = (0, 200, 0), (0, 0, 200)
    pictures = []
    for entry, (inside, outside) in enumerate([(moss, ember), (ember, moss)]):
        x = np.full((100, 100, 3), outside, np.uint8)
        x[12:62, 8:92] = inside
        pictures.append((entry, f"id{entry}", "minion", 100, 100, x.tobytes()))
    gallery = spark.createDataFrame(pictures, "entry int, identity string, role string, w int, h int, pixels binary")
    crops = spark.createDataFrame([(1, 0, 50, 50, np.full((50, 50, 3), moss, np.uint8).tobytes())], "frame int, slot int, crop_w int, crop_h int, crop binary")
    assert pipeline.classical_identifier(gallery)(crops).first().identity == "id1"


def test_boxes_and_identities_must_pair(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6)], "frame int, slot int, x double")
    b = spark.createDataFrame([(1, 0, "A"), (1, 1, "B")], "frame int, slot int, identity string")
    assert catalog.zipped(a, b, "frame", "slot").count() == 2
    with pytest.raises(Exception, match="differ in number"):
        catalog.zipped(a, b.where("slot = 0"), "frame", "slot").collect()


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_two_best_by_broadcast_and_by_blocks(spark, limit, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_A_TASK", 20)
    rng = np.random.default_rng(1)
    x, refs = rng.normal(size=(50, 4)), rng.normal(size=(13, 4))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id int, v array<double>").repartition(3)
    names = spark.createDataFrame([(f"n{k:02}", v.tolist()) for k, v in enumerate(refs)] + [("n99", refs[0].tolist())], "name string, v array<double>")
    got = {r["id"]: r for r in vectors.two_best(rows, ["id"], "v", names, "name", "v", limit=limit).collect()}
    assert len(got) == 51 and got[99]["top1"] == 0
    for k, v in enumerate(x):
        want = sorted(((float(v @ r), f"n{j:02}") for j, r in [*enumerate(refs), (99, refs[0])]), key=lambda p: (-round(p[0], 12), p[1]))[:2]
        assert (got[k]["best"], got[k]["second"]) == (want[0][1], want[1][1]) and abs(got[k]["top1"] - want[0][0]) < 1e-12
    hashes = spark.createDataFrame([(k, int(h)) for k, h in enumerate(rng.integers(-(1 << 62), 1 << 62, 30))], "id int, h long")
    known = spark.createDataFrame([(k, int(h)) for k, h in enumerate(rng.integers(-(1 << 62), 1 << 62, 9))], "ref int, h long")
    near = {r["id"]: r for r in vectors.ratio_matches(hashes, known, ["id"], "h", "ref", "h", 0.9, limit=limit).collect()}
    for r in hashes.collect():
        d = sorted(((r["h"] ^ q["h"]) & (1 << 64) - 1).bit_count() for q in known.collect())
        assert (near[r["id"]]["d1"], near[r["id"]]["d2"], near[r["id"]]["good"]) == (d[0], d[1], d[0] < 0.9 * d[1])
    none = vectors.two_best(hashes, ["id"], "h", known.where("false"), "ref", "h").collect()
    assert len(none) == 30 and all(r["best"] is None and r["top1"] is None for r in none)


def test_a_long_group_is_walked_once(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("v").alias("video"), F.col("id").alias("i"), F.xxhash64("id").alias("dhash"))
    kept = frames.dedup_last_kept(rows, "video", ["i"]).where("kept").count()
    assert 0.99 * n < kept <= n


def test_exact_rounding(spark):
    xs = [k / 10000 * 0.7 for k in range(10001)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(xs)] + [(-1, None)], "k int, x double").select("k", scalar.exact_round(F.col("x"), 4).alias("y")).collect()
    assert all(r["y"] == (None if r["k"] < 0 else round(xs[r["k"]], 4)) for r in got)


def test_iso_time(spark):
    at = lambda s: spark.range(1).select(scalar.iso_time(F.lit(s)).alias("x")).first()["x"]
    assert [at(0.0), at(1704067199.9), at(-1.0)] == ["1970-01-01T00:00:00+00:00", "2023-12-31T23:59:59+00:00", "1969-12-31T23:59:59+00:00"]


def test_limits_union_and_lookup(spark):
    rows = spark.createDataFrame([(k % 2, k) for k in range(10)], "v int, i int")
    assert sorted(r["i"] for r in frames.first_of(rows, "v", ["i"], 2).collect()) == [0, 1, 2, 3]
    assert frames.first_of(rows, "v", ["i"], 0).count() == 10 and sorted(r["i"] for r in frames.first_of(rows, None, ["i"], 3).collect()) == [0, 1, 2]
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    assert [r["name"] for r in catalog.skipped_union(names("b", "a"), names("b", "c")).collect()] == ["a", "b", "c"]
    files = spark.createDataFrame([("d/a_2.png",), ("d/a_1.png",), ("d/ab.png",)], "path string")
    found = {r["p"]: r["path"] for r in catalog.stem_lookup(names("a_", "ab", "zz", "a").withColumnRenamed("name", "p"), "p", files, "path").collect()}
    assert found == {"a_": "d/a_1.png", "ab": "d/ab.png", "zz": None, "a": "d/a_1.png"}


def test_sinks(spark, tmp_path, shots, pictures):
    out = pipeline.run(shots.where("frame in (1, 2)"), identifier=pipeline.classical_identifier(pictures))
    catalog.write_snapshots(out, str(tmp_path / "s"), "frame")
    files = list((tmp_path / "s" / "frame=1").glob("*.txt"))
    assert len(files) == 1 and json.loads(files[0].read_text())["cards"][0]["identity"] == "Moss"
    entries = spark.createDataFrame([("demon", "A", "2.png"), ("demon", "A", "1.png"), ("minion", "B", "3.png")], "role string, identity string, file string")
    skipped = spark.createDataFrame([("z",), ("a",), ("z",)], "name string")
    catalog.write_manifest(catalog.manifest(entries, "role", "identity", "file"), skipped, str(tmp_path / "m"))
    doc = json.loads(spark.read.text(str(tmp_path / "m")).first()["value"])
    assert doc == {"roles": {"demon": {"A": ["1.png", "2.png"]}, "minion": {"B": ["3.png"]}}, "skipped_images": ["a", "z"]}
    captures = spark.createDataFrame([(1, 0, 0.0, None), (1, 1, 0.5, "x")], "s int, i int, t double, note string")
    catalog.write_session(captures, resample.counters(captures.withColumn("size", F.lit("a")), "s", "i", "t", 2.0, "size"), str(tmp_path / "r"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "r" / "frames")).collect()]
    assert {"s": 1, "i": 0, "t": 0.0, "note": None} in lines and json.loads(spark.read.text(str(tmp_path / "r" / "session")).first()["value"])["submitted"] == 2


def test_settings(tmp_path):
    env = tmp_path / "env"
    env.write_text("# c\nGLEANER_IDENTIFIER='classical'\nGLEANER_CONFIDENCE_THRESHOLD=0.3\nOTHER=1\n")
    assert config.load(str(env), {}) == config.Settings("frames", 0.3, "classical")
    assert config.load(str(env), {"GLEANER_IDENTIFIER": "Ensemble"}).identifier == "ensemble"
    assert config.load(None, {"X_IDENTIFIER": "classical"}, "X_").identifier == "classical"
    for bad in ({"GLEANER_IDENTIFIER": "x"}, {"GLEANER_CONFIDENCE_THRESHOLD": "2"}):
        with pytest.raises(ValueError):
            config.load(None, bad)


def test_sources(spark, tmp_path):
    rgb = np.zeros((10, 8, 3), np.uint8)
    rgb[..., 0] = 200
    alpha = np.zeros((10, 8, 4), np.uint8)
    alpha[..., 3] = 51
    for role, identity, stem, picture in (("Demon", "Imp", "b", rgb), ("Demon", "Twin_Imp", "a", rgb), ("minion", "Spy", "c", alpha)):
        write_png(tmp_path / "g" / role / identity / f"{stem}.png", picture)
    (tmp_path / "g" / "Demon" / "Imp" / "broken.png").write_bytes(b"not a picture")
    tree = images.gallery_tree(spark, str(tmp_path / "g"), {"Twin_Imp": "Imp"})
    assert sorted((r["role"], r["identity"], r["file_stem"]) for r in tree.collect()) == [("demon", "Imp", "a"), ("demon", "Imp", "b"), ("minion", "Spy", "c")]
    refs = {r["file_stem"]: r for r in pixels.references(tree).collect()}
    assert (refs["a"]["w"], refs["a"]["h"]) == (8, 8) and bytes(refs["a"]["pixels"])[:3] == bytes([0, 0, 200])
    assert bytes(refs["c"]["pixels"])[:3] == bytes([204] * 3)  # black at a fifth, on white
    with pytest.raises(FileNotFoundError):
        images.gallery_tree(spark, str(tmp_path / "none"))
    (tmp_path / "bare").mkdir()
    with pytest.raises(ValueError, match="no images"):
        images.gallery_tree(spark, str(tmp_path / "bare"))
    for name in ("b.png", "a.png", "sub/d.png"):
        write_png(tmp_path / "flat" / name, rgb)
    (tmp_path / "flat" / "c.txt").write_text("x")
    stems = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert stems(images.collection(spark, str(tmp_path / "flat"))) == ["a.png", "b.png"]
    assert stems(images.collection(spark, str(tmp_path / "flat"), 1)) == ["a.png"] and stems(images.collection(spark, str(tmp_path / "flat" / "b.png"))) == ["b.png"]
    assert images.collection(spark, str(tmp_path / "gone")).count() == 0


def test_model_input():
    x = np.zeros((50, 70, 3), np.uint8)
    x[..., 2] = 255
    y = pixels.model_input(x)
    assert y.shape == (3, 224, 224) and np.allclose(y[0], (1 - 0.485) / 0.229, atol=1e-5) and np.allclose(y[2], -0.406 / 0.225, atol=1e-5)
    ramp = np.repeat(np.arange(224, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(224, axis=0)
    assert np.allclose(pixels.model_input(ramp)[1] * 0.224 + 0.456, np.arange(224)[None, :] / 255, atol=1e-6)


def test_reference_of_one_row():
    assert pixels.reference_image(bytes([7, 9]), 2, 1, 1).tolist() == [[[7, 7, 7], [9, 9, 9]]]


def test_kernels_see_a_frame_once(spark, monkeypatch):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("frame_stats", "candidate_boxes")}

    def noting(name):
        kernel = getattr(pixels, name)

        def run(shots, frame):
            def note(batches):
                for batch in batches:
                    seen[name].add(len(batch))
                    yield batch

            return kernel(shots.select(frame, "w", "h", "pixels").mapInPandas(note, "frame int, w int, h int, pixels binary"), frame)

        return run

    for name in seen:
        monkeypatch.setattr(pixels, name, noting(name))
    shots = spark.createDataFrame([(k, 640, 360, frame_bytes((200, 120, 70, 90, GREEN))) for k in range(6)], "frame int, w int, h int, pixels binary")
    out = pipeline.run(shots).collect()
    assert [len(r["cards"]) for r in out] == [1] * 6
    assert {name: a.value for name, a in seen.items()} == {"frame_stats": 6, "candidate_boxes": 6}
