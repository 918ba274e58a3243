"""Frame files by stride, and writers that leave all or nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.sources import files


@pytest.fixture
def folder(spark, tmp_path):
    """Two videos of 40 frames; only those that may be opened can be."""
    frames = spark.range(80).select(F.when(F.col("id") < 40, "a_b").otherwise("c").alias("video"), (F.col("id") % 40).alias("frame_index"), F.concat(F.lit("frame "), F.col("id")).cast("binary").alias("content")).repartition(5)
    files.write_frames(frames, str(tmp_path / "frames"))
    return tmp_path / "frames"


def test_stride_and_filters_open_no_other_file(spark, folder):
    assert len(list(folder.iterdir())) == 80
    opened = {f"{v}_{i:06d}.bin" for v in ("a_b", "c") for i in range(0, 40, 7)}
    for p in folder.iterdir():
        if p.name not in opened:
            p.unlink()
            os.mkfifo(p)  # opening it would wait for ever
            p.unlink()
            p.mkdir()  # and reading a folder fails
    got = files.strided_files(spark, str(folder), 7, 14.0).collect()
    assert sorted((r.video, r.frame_index, r.timestamp_s, bytes(r.content).decode()) for r in got) == sorted((v, i, i / 14.0, f"frame {i + (0 if v == 'a_b' else 40)}") for v in ("a_b", "c") for i in range(0, 40, 7))


def test_filters_are_pushed_to_the_plan_of_files(spark, folder):
    for p in folder.glob("*_0000[3-9]*"):
        p.write_bytes(b"bad")
        p.chmod(0)
    df = files.strided_files(spark, f"file://{folder}", 5).where("video = 'c' and frame_index < 25 and frame_index >= 5 and frame_index in (5, 10, 20, 35)")
    assert sorted(r.frame_index for r in df.collect()) == [5, 10, 20]
    reader = files._FrameReader({"path": str(folder), "stride": "5", "run_frames": "2"})
    assert list(reader.pushFilters([files.EqualTo(("video",), "c"), files.LessThan(("frame_index",), 25), files.EqualTo(("content",), b"")])) == [files.EqualTo(("content",), b"")]
    assert [[f[1] for f in p.frames] for p in reader.partitions()] == [[0, 5], [10, 15], [20]]


def test_no_folder_no_rows_and_bad_options(spark, tmp_path):
    assert files.strided_files(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="positive"):
        files.strided_files(spark, str(tmp_path), 0).collect()


def test_documents_and_session(spark, tmp_path):
    records = spark.range(30).select(F.format_string("v_%03d", "id").alias("stem"), F.when(F.col("id") % 3 == 0, "menu").otherwise("board").alias("state"), F.to_json(F.struct("id")).alias("document")).repartition(4)
    files.write_documents(records, str(tmp_path / "out"))
    found = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert found == sorted([f"v_{k:03d}.json" for k in range(30)] + ["session.json"])
    assert json.loads((tmp_path / "out" / "v_007.json").read_text()) == {"id": 7}
    assert json.loads((tmp_path / "out" / "session.json").read_text()) == {"documents": 30, "state_board": 20, "state_menu": 10}


@pytest.mark.parametrize("fault", ["task", "names"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, fault):
    stem = F.when(F.col("id") == 29, "a/b").otherwise(F.concat(F.lit("v"), F.col("id"))) if fault == "task" else F.concat(F.lit("v"), F.col("id") % 29)
    records = spark.range(30).select(stem.alias("stem"), F.lit("board").alias("state"), F.lit("{}").alias("document")).repartition(4)
    with pytest.raises(Exception, match="file name"):
        files.write_documents(records, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "stem string, state string, document string")
    files.write_documents(none, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "session.json").read_text()) == {"documents": 0}
