"""Combining two identifiers, discounts, and the statistics of their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalar import UNKNOWN, exact_round

BOOST = 0.15
TINT, KEEP = 0.7, 0.5
LEAST_CORRELATION, CLOSE, LEAST_MATCHES = 0.40, 0.05, 4


def combined(classical: DataFrame, embedding: DataFrame, key: str) -> DataFrame:
    """Two verdicts (key, identity, role, confidence) a key, either of which may be missing -> (key, identity, role, confidence, source).

    Both unknown: unknown at 0. The same identity: the classical role, the higher confidence plus
    BOOST, at most 1. Different ones: unknown at 0. One known: that one, unchanged. A null role is unknown.
    """
    side = lambda df, x: df.select(F.col(key).alias(f"_{x}"), F.col("identity").alias(f"{x}i"), F.col("role").alias(f"{x}r"), F.col("confidence").alias(f"{x}c"))
    filled = [F.coalesce(x, F.lit(UNKNOWN)).alias(x) for x in ("ci", "ei", "cr", "er")] + [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("cc", "ec")]
    both = side(classical, "c").join(side(embedding, "e"), F.col("_c") == F.col("_e"), "full").select(F.coalesce("_c", "_e").alias(key), *filled)
    no_c, no_e, same = F.col("ci") == UNKNOWN, F.col("ei") == UNKNOWN, F.col("ci") == F.col("ei")
    source = F.when(no_c & no_e, "both_unknown").when(same, "agree").when(no_c, "embedding_only").when(no_e, "classical_only").otherwise("disagree_abstain")
    out = both.withColumn("source", source)
    src = F.col("source")
    taken = lambda c, e: F.when(src.isin("agree", "classical_only"), F.col(c)).when(src == "embedding_only", F.col(e)).otherwise(UNKNOWN)
    confidence = (
        F.when(src == "agree", F.round(F.least(F.lit(1.0), F.greatest("cc", "ec") + BOOST), 4)).when(src == "classical_only", F.col("cc")).when(src == "embedding_only", F.col("ec")).otherwise(0.0)
    )
    return out.select(key, taken("ci", "ei").alias("identity"), taken("cr", "er").alias("role"), confidence.alias("confidence"), "source")


def tint_discounted(identity: Column, role: Column, confidence: Column, tinted: Column) -> tuple[Column, Column, Column]:
    """(identity, role, confidence): a tinted reading's confidence times TINT, to four digits; unknown below KEEP."""
    low = exact_round(confidence * TINT, 4)
    lost = tinted & (low < KEEP)
    return F.when(lost, UNKNOWN).otherwise(identity), F.when(lost, UNKNOWN).otherwise(role), F.when(tinted, low).otherwise(confidence)


def correlated(best: Column, second: Column, best_id: Column, second_id: Column, best_matches: Column, second_matches: Column) -> tuple[Column, Column]:
    """(identity, score) of the histogram matcher: unknown under LEAST_CORRELATION; of two close ones the second if it has more keypoint matches, LEAST_MATCHES at least."""
    take = (best - second < CLOSE) & (second_matches > best_matches) & (second_matches >= LEAST_MATCHES)
    low = F.coalesce(best, F.lit(0.0)) < LEAST_CORRELATION
    take = F.coalesce(take, F.lit(False))
    return F.when(low, UNKNOWN).when(take, second_id).otherwise(best_id), F.round(F.when(take & ~low, second).otherwise(F.coalesce(best, F.lit(0.0))), 4)


def mining_stats(crops: DataFrame, video: str, frame: str, classical: str, embedding: str) -> DataFrame:
    """Per video and in total (grand: true): frames, crops, agreements, both unknown, share of agreement in percent."""
    agree = F.col(classical) == F.col(embedding)
    none = agree & (F.col(classical) == UNKNOWN)
    out = crops.rollup(video).agg(
        F.countDistinct(frame).alias("frames"), F.count(F.lit(1)).alias("crops"), F.count_if(agree).alias("agreements"), F.count_if(none).alias("both_unknown"), F.grouping(video).alias("_g")
    )
    return out.select(video, (F.col("_g") == 1).alias("grand"), "frames", "crops", "agreements", "both_unknown", F.round(F.try_divide(100.0 * F.col("agreements"), F.col("crops")), 4).alias("agree_pct"))


def head_to_head(rows: DataFrame, classical: str, embedding: str) -> DataFrame:
    """One row of counters: identified and unknown by each side, agreements (unknown = unknown counts) and disagreements."""
    known = lambda c: F.col(c) != UNKNOWN
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known(classical)).alias("classical_identified"), F.count_if(~known(classical)).alias("classical_unknown"), F.count_if(known(embedding)).alias("embedding_identified"),
        F.count_if(~known(embedding)).alias("embedding_unknown"), F.count_if(F.col(classical) == F.col(embedding)).alias("agree"), F.count_if(F.col(classical) != F.col(embedding)).alias("disagree"),
    )
