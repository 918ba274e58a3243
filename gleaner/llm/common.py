"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: A lookup table is broadcast up to this many bytes and joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's checkpoint folder; a local one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted rows stay below `limit` bytes; unhinted (a shuffled join) otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def words_of(text: Column) -> Column:
    """The whitespace-delimited words of a text; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def as_row(docs: DataFrame) -> Column:
    """All columns of `docs` as one struct `row`: no name of theirs can then clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def columns_of(row: str, names: list[str]) -> list[Column]:
    """The columns that `as_row` took."""
    return [F.col(row)[c].alias(c) for c in names]
