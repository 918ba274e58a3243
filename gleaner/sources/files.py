"""Python data sources: numbered frame files read by stride, and writers that leave all or nothing.

`frame_files` reads files `video_000123.png` below a folder as (video, frame_index, timestamp_s,
content). Names are listed once, when the scan is planned. What the stride leaves out, and what a
filter on video or frame_index excludes, is never opened; the rest is planned as runs of frames.

Writers put each task's files in a staging folder, under the task's own name for them; a commit
moves the staging folder's files into place and adds what the tasks counted, an abort removes it.
A move is a rename by the driver: a folder of one file a frame is meant for a session or a clip, and
tables of all frames are written as Parquet.
Paths are of any file system that Arrow knows by URI; it must be one that executors share.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Frames of a planned partition, and bytes of a batch.
RUN_FRAMES, BATCH_BYTES = 256, 8 << 20
_NAME = re.compile(r"(.+)_(\d+)\.[A-Za-z0-9]+$")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", path))


@dataclass
class _Run(InputPartition):
    frames: list[tuple[str, int, str]]  # video, index, path


def _keeps(f: Filter, video: str, index: int) -> bool:
    value = video if f.attribute == ("video",) else index
    return {EqualTo: lambda: value == f.value, In: lambda: value in f.value, GreaterThan: lambda: value > f.value, GreaterThanOrEqual: lambda: value >= f.value, LessThan: lambda: value < f.value, LessThanOrEqual: lambda: value <= f.value}[type(f)]()


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._path, self._fps = options["path"], float(options.get("media_fps", 30.0))
        self._stride, self._run = int(options.get("stride", 1)), int(options.get("run_frames", RUN_FRAMES))
        if self._stride < 1 or self._fps <= 0:
            raise ValueError("stride and media_fps must be positive")
        self._filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("video",), ("frame_index",)):
                self._filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, base = _opened(self._path)
        found = []
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = _NAME.match(info.base_name)
            if info.is_file and name:
                video, index = name[1], int(name[2])
                if index % self._stride == 0 and all(_keeps(f, video, index) for f in self._filters):
                    found.append((video, index, info.path))
        found.sort()
        return [_Run(found[k : k + self._run]) for k in range(0, len(found), self._run)] or [_Run([])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self._path)
        rows: list[tuple] = []
        size = 0
        for video, index, path in partition.frames:
            with files.open_input_stream(path) as f:
                data = f.read()
            rows.append((video, index, index / self._fps, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["video", "frame_index", "timestamp_s", "content"])


@dataclass
class _Told(WriterCommitMessage):
    """Files of a task, and what it counted."""

    names: list[str]
    counts: dict[str, int]


class _Staged(DataSourceWriter):
    """Writes the file that `_file(row)` names and fills, once a name."""

    def __init__(self, options: dict[str, str]) -> None:
        self._path, self._staging = options["path"], f".staging-{uuid.uuid4().hex}"

    def _file(self, row: object) -> tuple[str, bytes]:
        raise NotImplementedError

    def _count(self, row: object, counts: dict[str, int]) -> None:
        counts["files"] = counts.get("files", 0) + 1

    def write(self, iterator: Iterator[object]) -> _Told:
        files, base = _opened(self._path)
        own = uuid.uuid4().hex  # a task that runs again writes beside what its first run left
        files.create_dir(f"{base}/{self._staging}/{own}", recursive=True)
        names, counts = [], {}
        for row in iterator:
            name, data = self._file(row)
            if "/" in name or not name:
                raise ValueError(f"not a file name: {name!r}")
            with files.open_output_stream(f"{base}/{self._staging}/{own}/{name}") as f:
                f.write(data)
            names.append(f"{own}/{name}")
            self._count(row, counts)
        return _Told(names, counts)

    def commit(self, messages: list[_Told | None]) -> None:
        files, base = _opened(self._path)
        told = [m for m in messages if m is not None]
        every = [n for m in told for n in m.names]
        if len({n.partition("/")[2] for n in every}) < len(every):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        for n in every:
            files.move(f"{base}/{self._staging}/{n}", f"{base}/{n.partition('/')[2]}")
        self._done(files, base, told)
        files.delete_dir(f"{base}/{self._staging}")

    def _done(self, files: fs.FileSystem, base: str, told: list[_Told]) -> None:
        """After all files are in place."""

    def abort(self, messages: list[_Told | None]) -> None:
        files, base = _opened(self._path)
        if files.get_file_info(f"{base}/{self._staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self._staging}")


class _FrameWriter(_Staged):
    def _file(self, row: object) -> tuple[str, bytes]:
        return f"{row['video']}_{row['frame_index']:06d}.bin", bytes(row["content"])


class _SessionWriter(_Staged):
    """A document a frame stem, and session.json with the counts of all tasks."""

    def _file(self, row: object) -> tuple[str, bytes]:
        return f"{row['stem']}.json", row["document"].encode()

    def _count(self, row: object, counts: dict[str, int]) -> None:
        for key in ("documents", f"state_{row['state']}"):
            counts[key] = counts.get(key, 0) + 1

    def _done(self, files: fs.FileSystem, base: str, told: list[_Told]) -> None:
        total: dict[str, int] = {"documents": 0}
        for m in told:
            for key, n in m.counts.items():
                total[key] = total.get(key, 0) + n
        with files.open_output_stream(f"{base}/session.json") as f:
            f.write(json.dumps(total, sort_keys=True).encode())


class FrameFiles(DataSource):
    """Options: path; stride, media_fps, run_frames for reading."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "video string, frame_index long, timestamp_s double, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FrameWriter(self.options)


class SessionFiles(DataSource):
    """Written from (stem, state, document). Options: path."""

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        return "stem string, state string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SessionWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameFiles)
    spark.dataSource.register(SessionFiles)


def strided_files(spark: SparkSession, path: str, stride: int = 1, media_fps: float = 30.0) -> DataFrame:
    """(video, frame_index, timestamp_s, content) of every stride-th frame file; no such folder: no rows."""
    register(spark)
    return spark.read.format("frame_files").options(path=path, stride=str(stride), media_fps=str(media_fps)).load()


def write_frames(frames: DataFrame, path: str) -> None:
    """frames (video, frame_index, content) as files that `strided_files` reads."""
    register(frames.sparkSession)
    frames.selectExpr("video", "cast(frame_index as long) as frame_index", "cast(null as double) as timestamp_s", "content").write.format("frame_files").option("path", path).mode("append").save()


def write_documents(records: DataFrame, path: str) -> None:
    """records (stem, state, document): a JSON document a stem, all or none, and session.json."""
    register(records.sparkSession)
    records.select("stem", "state", "document").write.format("session_files").option("path", path).mode("append").save()
