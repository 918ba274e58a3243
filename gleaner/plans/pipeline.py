"""From decoded frames to nested records, as one plan of DataFrame steps.

gate, localize, crop, identify, discount tinted frames, assemble. The state filter stands before the
pixel kernels, and the pixels are dropped with the crops. Each step is a function of a table, so
that another one can take its place; identifiers are made by factories that close over a gallery.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalar import UNKNOWN
from gleaner.operators import boxes, catalog, identify, pixels, vectors
from gleaner.operators import frames as selection
from gleaner.operators.durable import written
from gleaner.operators.sizes import small_or_not

#: Adds identity, role and confidence to a table of crops (frame, slot, crop_w, crop_h, crop).
Identifier = Callable[[DataFrame], DataFrame]
Localizer = Callable[[DataFrame, str], DataFrame]


def unknown_identifier(crops: DataFrame) -> DataFrame:
    """Names nothing: unknown at confidence 0."""
    return crops.withColumns({"identity": F.lit(UNKNOWN), "role": F.lit(UNKNOWN), "confidence": F.lit(0.0)})


def nothing_localized(frames: DataFrame, frame: str) -> DataFrame:
    """Finds no card."""
    kind = dict(frames.dtypes)[frame]
    return frames.sparkSession.createDataFrame([], f"`{frame}` {kind}, slot int, x double, y double, w double, h double, box_id string")


def localized(frames: DataFrame, frame: str) -> DataFrame:
    """(frame, slot, x, y, w, h, box_id): card boxes after the geometry, zone and overlap filters."""
    found = pixels.candidate_boxes(frames, frame)
    fine = boxes.outside_zones(boxes.shaped(found, F.col("frame_w"), F.col("frame_h")))
    return boxes.suppressed(fine.select(frame, "x", "y", "w", "h", F.format_string("%.6f/%.6f", "y", "x").alias("box_id")), frame, "box_id")


def _named(crops: DataFrame, verdicts: DataFrame, frame: str) -> DataFrame:
    """Crops with their verdicts (frame, slot, identity, role, confidence); unknown where there is none."""
    out = crops.join(verdicts, [frame, "slot"], "left")
    return out.withColumns({"identity": F.coalesce("identity", F.lit(UNKNOWN)), "role": F.coalesce("role", F.lit(UNKNOWN)), "confidence": F.coalesce("confidence", F.lit(0.0))})


def classical_identifier(gallery: DataFrame, frame: str = "frame", descriptors: DataFrame | None = None, reference_descriptors: DataFrame | None = None) -> Identifier:
    """By correlation of the hue-saturation histogram of a crop's art band with those of the gallery's pictures (entry, identity, role, w, h, pixels).

    The pictures are whole references, as `pixels.references` loads them. Of equal ones the lower entry is best.

    Of two close ones the second is taken if it has more keypoint matches: descriptors (frame, slot,
    hash) against reference_descriptors (entry, hash), if given.
    """
    entries = pixels.art_histograms(gallery.select("entry", "w", "h", "pixels"), "w", "h", "pixels", band=False).select("entry", "vector")
    names = gallery.select(F.col("entry").cast("string").alias("best"), "identity", "role")

    def named(crops: DataFrame) -> DataFrame:
        whole = crops.where(F.col("crop").isNotNull()).select(frame, "slot", "crop_w", "crop_h", "crop")
        seen = pixels.art_histograms(whole, "crop_w", "crop_h", "crop").where(F.exists("vector", lambda x: x != 0))
        top = vectors.two_best(seen, [frame, "slot"], "vector", entries, "entry", "vector", digits=9)
        clamp = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        top = top.select(frame, "slot", "best", "second", clamp("top1").alias("s1"), clamp("top2").alias("s2")).withColumns({"m1": F.lit(0), "m2": F.lit(0)})
        if descriptors is not None and reference_descriptors is not None:
            crop = F.struct(frame, "slot").alias("crop")
            pairs = top.select(crop, F.explode(F.array("best", "second")).alias("entry")).where("entry is not null")
            refs = reference_descriptors.select(F.col("entry").cast("string").alias("entry"), F.col("hash").alias("ref_hash"))
            counts = vectors.match_counts(pairs, "crop", "entry", descriptors.select(crop, "hash"), "hash", refs, "ref_hash")
            each = lambda name, m: counts.select(F.col(f"crop.{frame}").alias(frame), F.col("crop.slot").alias("slot"), F.col("entry").alias(name), F.col("matches").alias(m))
            top = top.drop("m1", "m2").join(each("best", "m1"), [frame, "slot", "best"], "left").join(each("second", "m2"), [frame, "slot", "second"], "left")
        entry, score = identify.correlated(F.col("s1"), F.col("s2"), F.col("best"), F.col("second"), F.coalesce("m1", F.lit(0)), F.coalesce("m2", F.lit(0)))
        verdicts = top.select(frame, "slot", entry.alias("best"), score.alias("confidence")).join(names, "best", "left").drop("best")
        return _named(crops, verdicts, frame)

    return named


def embedding_identifier(protos: DataFrame, embed: Callable[[DataFrame], DataFrame], frame: str = "frame", margin: float = vectors.MARGIN) -> Identifier:
    """By the margin of cosines to prototypes (identity, role, proto); `embed` adds `embedding` to a table of crops, see `pixels.model_input`."""
    roles = protos.groupBy("identity").agg(F.min("role").alias("role"))

    def named(crops: DataFrame) -> DataFrame:
        seen = embed(crops.where(F.col("crop").isNotNull()))
        found = vectors.nearest(seen, protos, [frame, "slot"], "identity", "embedding", margin)
        return _named(crops, found.select(frame, "slot", "identity", "confidence").join(roles, "identity", "left"), frame)

    return named


def ensemble_identifier(classical: Identifier, embedding: Identifier, frame: str = "frame") -> Identifier:
    """Both, combined: a role is that of the verdict that is taken."""

    def named(crops: DataFrame) -> DataFrame:
        key = F.struct(frame, "slot").alias("key")
        c, e = (f(crops).select(key, "identity", "role", "confidence") for f in (classical, embedding))
        out = identify.combined(c, e, "key").select(F.col(f"key.{frame}").alias(frame), F.col("key.slot").alias("slot"), "identity", "role", "confidence")
        return _named(crops, out, frame)

    return named


def chosen_identifier(name: str, classical: Callable[[], Identifier], embedding: Callable[[], Identifier] | None, frame: str = "frame") -> Identifier:
    """The identifier that the settings name; without a model it is the classical one, with a warning."""
    if name == "classical":
        return classical()
    if embedding is None:
        warnings.warn(f"no model for the {name} identifier: the classical one is used", stacklevel=2)
        return classical()
    return ensemble_identifier(classical(), embedding(), frame) if name == "ensemble" else embedding()


def gated(frames: DataFrame, frame: str) -> DataFrame:
    """frames (frame, w, h, pixels) -> (frame, state, tinted, w, h): what is known of a frame without its pixels."""
    stats = pixels.frame_stats(frames, frame)
    state = selection.gate(F.coalesce("mean", F.lit(0.0)), F.col("center"), F.coalesce("ring", F.lit(1.0)))
    return stats.select(frame, state.alias("state"), F.coalesce(F.col("red") >= selection.RED, F.lit(False)).alias("tinted"), "w", "h")


def run(frames: DataFrame, frame: str = "frame", identifier: Identifier = unknown_identifier, localizer: Localizer = localized, discount: bool = True) -> DataFrame:
    """frames (frame, w, h, pixels; and, if known, state and tinted) -> one nested record a frame; only boards are localized.

    Each kernel sees a frame once: what the gate, the localizer and the crops give is written, and
    goes to the pixels while it is small, so that pixels are not shuffled.
    """
    if "state" in frames.columns:
        stated = frames if "tinted" in frames.columns else frames.withColumn("tinted", F.lit(False))
        known, board = stated.select(frame, "state", "tinted", "w", "h"), stated.where(F.col("state") == "board")
        whole = board
    else:
        known = written(gated(frames, frame))
        board = frames.drop("tinted").join(small_or_not(known.where(F.col("state") == "board").select(frame, "state", "tinted"), 40), frame)
        whole = frames  # of which only boards have boxes
    found = written(localizer(board, frame).select(frame, "slot", "x", "y", "w", "h"))
    cut = written(pixels.crops(whole, small_or_not(found, 64), frame))
    named = identifier(cut).select(frame, "slot", "identity", "role", "confidence")
    cards = catalog.zipped(found, named, frame, "slot")
    if discount:
        identity, role, confidence = identify.tint_discounted(F.col("identity"), F.col("role"), F.col("confidence"), F.col("tinted"))
        cards = cards.join(known.select(frame, "tinted"), frame).select(frame, "slot", "x", "y", "w", "h", identity.alias("identity"), role.alias("role"), confidence.alias("confidence"))
    return catalog.snapshots(known.select(frame, "state", "w", "h"), cards, frame)
