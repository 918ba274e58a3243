"""A corpus pipeline of five stages: what each keeps is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, mixing, quality, sharding, simhash
from gleaner.llm.common import read_table, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the n-gram likelihood ratio reject."""
    return quality.kept_rows(docs, quality.trusted_ids(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring sources to their target weights; a document of a small source may come twice."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle all rows into shards."""
    return sharding.external_shuffle(docs)


STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: Hashed n-grams, SimHash and seeded shuffles are not SQL's; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "source", "n_chars", "shard", "slot")
