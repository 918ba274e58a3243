"""The tables as frames, boxes, pixels and galleries.

There is no video among the tables; each view says which columns stand in for what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.resample import seconds_of
from gleaner.operators.vectors import vector_hash

FRAME_W, FRAME_H = 1280, 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captured frames: the user is the session."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", seconds_of(F.col("ts")).alias("seconds"))


def board_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as frames of a user's game, errors as modals and sign-ups as menus; and the reads of one of three slots a frame: now and then another identity, now and then none."""
    k = F.from_json("props", "k int")["k"]
    state = F.when(F.col("event_type") == "error", "modal").when(F.col("event_type") == "signup", "menu").otherwise("board")
    events = captures(spark, sf_dir).select("user_id", F.col("event_id").alias("frame"), "seconds", state.alias("state"), k.alias("k"))
    slot = F.col("k") % 3
    identity = F.when(F.col("k") % 11 == 0, "unknown").when(F.col("k") % 13 == 0, "face_down").otherwise(F.concat(F.lit("id"), ((F.col("user_id") + slot + (F.col("k") % 5 == 0).cast("int")) % 7).cast("string")))
    reads = events.select("user_id", "frame", slot.alias("slot"), identity.alias("identity"), (F.col("frame") * 37 % 100 / 100.0).alias("margin"))
    return events.drop("k"), reads


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 thumbnails with a 56-bit gradient hash: the label is the video."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vector_hash(F.col("embedding")).alias("dhash"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate boxes: the order is the frame."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") * F.lit(1000000000000) + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).cast("long").alias("box_id"),
        (F.col("l_partkey") % 80 / 100.0).alias("x"), (F.col("l_suppkey") % 75 / 100.0).alias("y"), (0.04 + F.col("l_quantity") % 10 / 100.0).alias("w"), (0.06 + F.col("l_linenumber") / 50.0).alias("h"), "l_linenumber", "l_partkey", "l_quantity", "l_discount",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of 64 x 64 frames: the supplier is the frame."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("shot"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y"), (F.col("l_quantity") * (F.col("l_suppkey") % 9 + 1)).alias("v"),
        (F.col("l_quantity") * 5).alias("r"), (F.col("l_discount") * 2550).alias("g"), (F.col("l_tax") * 2550).alias("b"), (F.col("l_partkey") % 180).alias("hue"), (F.col("l_suppkey") * 7 % 256).alias("s"), (F.col("l_orderkey") % 256).alias("val"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and labels as two identifiers' verdicts on an item."""
    doc = F.col("doc_id")
    classical = table(spark, sf_dir, "documents").select("doc_id", F.when(doc % 7 == 0, "unknown").otherwise(F.col("lang")).alias("identity"), (F.col("n_chars") % 100 / 100.0).alias("confidence"), "source", F.when(doc % 2 == 0, "villager").otherwise("minion").alias("role"))
    embedding = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "unknown").when((F.col("quality") == 0) | (doc % 5 == 0), "en").otherwise("fr").alias("identity"), (doc % 90 / 100.0).alias("confidence"),
        F.when(doc % 3 == 0, "demon").when(doc % 3 == 1, "outcast").alias("role"),
    )
    return classical, embedding


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as references: region is the role, nation the identity."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("role"), F.col("n_name").alias("identity"), F.col("s_name").alias("file"))


#: Blue, green and red of the cards that `blob_frames` draws, by supplier modulo their number, with identity and role.
CARDS = (("00C800", "Moss", "villager"), ("C80064", "Iris", "minion"), ("0000C8", "Ember", "demon"))
BLOB_W, BLOB_H = 160, 90


def _card(supplier: Column) -> tuple[Column, Column, Column, Column]:
    """(x, y, w, h) of a supplier's card in pixels: free of the fixed zones, and large enough."""
    n = supplier.cast("int")
    return 48 + n % 7 * 4, 36 + n % 5 * 2, 18 + n % 4, 24 + n % 3 * 2


def blob_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame a supplier: grey, with one filled card; its bytes are put together by Spark."""
    n = F.col("s_suppkey")
    x, y, w, h = _card(n)
    colour = F.get(F.array(*[F.lit(c) for c, _, _ in CARDS]), (n % len(CARDS)).cast("int"))
    plain = lambda k: F.repeat(F.lit("646464"), k)
    card = F.concat(plain(x), F.repeat(colour, w), plain(BLOB_W - x - w))
    picture = F.concat(F.repeat(plain(F.lit(BLOB_W)), y), F.repeat(card, h), F.repeat(plain(F.lit(BLOB_W)), BLOB_H - y - h))
    # A small table makes large pictures: it is dealt to all cores first.
    dealt = table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    return dealt.select(n.cast("long").alias("frame"), F.lit(BLOB_W).alias("w"), F.lit(BLOB_H).alias("h"), F.unhex(picture).alias("pixels"))


def colour_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References for `blob_frames`: for each card colour that a supplier has, a plain picture."""
    k = (F.col("s_suppkey") % len(CARDS)).cast("int")
    rows = table(spark, sf_dir, "supplier").select(k.alias("entry")).distinct()
    of = lambda at: F.get(F.array(*[F.lit(c[at]) for c in CARDS]), F.col("entry"))
    return rows.select("entry", of(1).alias("identity"), of(2).alias("role"), F.lit(20).alias("w"), F.lit(20).alias("h"), F.unhex(F.repeat(of(0), 400)).alias("pixels"))
