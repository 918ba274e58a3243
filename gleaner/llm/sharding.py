"""Sharding: a two-pass external shuffle.

Pass one scatters rows by a seeded hash of all their columns into buckets, whose number follows from
the input's bytes and rows, so that a bucket fits in a task's memory however large the input is;
rows that are equal by the thousand are numbered and scatter by their number too. Pass two shuffles
each bucket (Spark's seeded `shuffle` is a Fisher-Yates), lays the buckets end to end and writes
them: that is one random order of all rows, and shard s is its s-th equal run. Shard sizes in rows
are at most one apart. Each row moves once, and its place follows from the rows and the seed alone:
buckets are dealt to tasks by their number, not by what a session's settings make of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import columns_of, read_table, shared_folder, small_or_not, stored

SEED = 20240517
N_SHARDS = 16
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 4096
#: Tasks of the second pass, at most; each has a run of buckets.
MOST_TASKS = 1 << 14
#: Equal rows from which on they are numbered.
EQUAL_ROWS = 1024
#: Of the sums of bucket sizes: so many buckets are one step of the coarse sum.
STEP = 4096


def _numbered(df: DataFrame, h: DataFrame, equal_rows: int) -> DataFrame:
    """`df` with `_n`, which tells equal rows apart where they are many (0 for all others).

    Equal rows are the same whichever is which: they travel as one with their count, and are made
    again in as many tasks as they need.
    """
    many = stored(h.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_times")).where(F.col("_times") > equal_rows))
    if many.isEmpty():
        return df.withColumn("_n", F.lit(0).cast("long"))
    met = df.join(small_or_not(many, 40), ["_h1", "_h2"], "left")
    one = met.where("_times is not null").groupBy("_h1", "_h2", "_row").agg(F.count(F.lit(1)).alias("_times"))
    runs = one.select("_h1", "_h2", "_row", "_times", F.explode(F.expr(f"sequence(0L, (_times - 1) div {equal_rows})")).alias("_run"))
    numbers = F.sequence(F.col("_run") * equal_rows, F.least((F.col("_run") + 1) * equal_rows, F.col("_times")) - 1)
    again = runs.repartition("_h1", "_run").select("_h1", "_h2", "_row", F.explode(numbers).alias("_n"))
    return met.where("_times is null").select("_h1", "_h2", "_row", F.lit(0).cast("long").alias("_n")).unionByName(again)


def _before(counts: DataFrame) -> DataFrame:
    """counts (_bucket, _n) -> (_bucket, _before): rows in all buckets before, summed by steps of buckets and within them."""
    counts = stored(counts.withColumn("_step", F.expr(f"_bucket div {STEP}")))
    steps = counts.groupBy("_step").agg(F.sum("_n").alias("_all"))
    steps = steps.select("_step", (F.sum("_all").over(Window.orderBy("_step")) - F.col("_all")).alias("_earlier"))
    within = F.sum("_n").over(Window.partitionBy("_step").orderBy("_bucket")) - F.col("_n")
    return counts.withColumn("_within", within).join(steps, "_step").select("_bucket", (F.col("_earlier") + F.col("_within")).alias("_before"))


def external_shuffle(
    df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, equal_rows: int = EQUAL_ROWS, most_tasks: int = MOST_TASKS
) -> DataFrame:
    """`df` plus `shard` (0 .. n_shards-1) and `slot` (gapless from 0 in each shard).

    A row's size is taken as the UTF-8 bytes of its `text` (null or no such column: none) plus 64.
    Rows that are equal in all columns stay separate rows with slots of their own. Nulls are values like any. A row larger than a bucket is in one with what else falls there.
    Fewer rows than shards: some shards are empty. Empty input: empty result. Columns named shard or
    slot are replaced; columns of map type, which have no hash, are not taken.
    """
    df = df.drop("shard", "slot")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in df.columns else F.lit(0)) + 64
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.select(F.xxhash64(F.lit(seed), *columns).alias("_h1"), F.xxhash64(F.lit(seed + 1), *columns).alias("_h2"), F.struct(*columns).alias("_row"), size.cast("long").alias("_size"))
    n, total = hashed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes), -(-n // bucket_rows))
    tasks = min(buckets, most_tasks)
    rows = _numbered(hashed.drop("_size"), hashed.select("_h1", "_h2"), equal_rows)
    rows = rows.withColumn("_bucket", F.when(F.col("_n") == 0, F.pmod("_h1", F.lit(buckets))).otherwise(F.pmod(F.xxhash64("_h1", "_n"), F.lit(buckets))))
    before = _before(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
    # Sorted arrays in sorted buckets, in a task that the bucket's number decides: one that runs again draws the same.
    dealt = (
        rows.select("_bucket", F.expr(f"cast(_bucket * {tasks} div {buckets} as int)").alias("_task"), F.struct("_h1", "_h2", "_n", "_row").alias("_x"))
        .repartitionById(tasks, "_task")
        .groupBy("_task", "_bucket")
        .agg(F.sort_array(F.collect_list("_x")).alias("_all"))
        .sortWithinPartitions("_bucket")
        .select("_bucket", F.posexplode(F.shuffle("_all", seed)).alias("_pos", "_x"))
    )
    placed = dealt.join(small_or_not(stored(before), 32), "_bucket").select(F.col("_x._row").alias("_row"), (F.col("_before") + F.col("_pos")).alias("_g"))
    shard = F.expr(f"cast(_g * {n_shards} div {max(n, 1)} as int)")
    out = placed.withColumn("_shard", shard).withColumn("_slot", F.expr(f"_g - (_shard * {n}L + {n_shards - 1}) div {n_shards}"))
    return out.select(*columns_of("_row", df.columns), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffle `df` and write one folder a shard: each task writes its buckets, a run of a shard's slots, or of two shards', in order."""
    external_shuffle(df, **options).write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle and write whole documents; the digest is of the written shards, read again."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    placed = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(folder)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    crc32 = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return placed.select("doc_id", size, crc32, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
