"""Candidate boxes: geometry filters, zones, overlap suppression, crops. Boxes are x, y, w, h as fractions of the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalar import pixel_edge

LEAST_AREA, MOST_AREA = 0.0015, 0.09
LEAST_ASPECT, MOST_ASPECT = 0.38, 1.40
ZONE_SHARE = 0.40
IOU = 0.30
#: X, y, w, h of screen zones that hold no card.
ZONES = (
    (0.00, 0.00, 0.13, 1.00),
    (0.92, 0.00, 0.08, 1.00),
    (0.00, 0.00, 1.00, 0.09),
    (0.00, 0.86, 1.00, 0.14),
    (0.82, 0.78, 0.18, 0.22),
    (0.12, 0.72, 0.05, 0.20),
    (0.00, 0.00, 0.27, 0.27),
    (0.84, 0.00, 0.16, 0.36),
    (0.15, 0.56, 0.07, 0.16),
    (0.78, 0.18, 0.08, 0.22),
)


def shaped(boxes: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """Boxes whose pixel area and width-to-height ratio are in bounds; a box without height has ratio 0."""
    pw, ph = F.col("w") * frame_w, F.col("h") * frame_h
    ratio = F.coalesce(F.try_divide(pw, ph), F.lit(0.0))
    area = pw * ph
    return boxes.where(area.between(LEAST_AREA * frame_w * frame_h, MOST_AREA * frame_w * frame_h) & ratio.between(LEAST_ASPECT, MOST_ASPECT))


def _covered(box: Column, zone: tuple[float, float, float, float]) -> Column:
    x0, y0, x1, y1 = F.lit(zone[0]), F.lit(zone[1]), F.lit(zone[0] + zone[2]), F.lit(zone[1] + zone[3])
    across = F.greatest(F.least(box["x"] + box["w"], x1) - F.greatest(box["x"], x0), F.lit(0.0))
    down = F.greatest(F.least(box["y"] + box["h"], y1) - F.greatest(box["y"], y0), F.lit(0.0))
    return F.coalesce(F.try_divide(across * down, box["w"] * box["h"]), F.lit(0.0))


def outside_zones(boxes: DataFrame, zones: tuple = ZONES, share: float = ZONE_SHARE) -> DataFrame:
    """Boxes of which no zone covers over `share` of the box's own area: a theta anti-join against a constant table, as one predicate.

    The box is put in a one-element array so that its columns are computed once and not for each zone.
    """

    def hit(box: Column) -> Column:
        out = F.lit(False)
        for z in zones:
            out = out | (_covered(box, z) > share)
        return out

    return boxes.where(~F.exists(F.array(F.struct("x", "y", "w", "h")), hit))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 if the union is empty."""
    across = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    down = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    both = across * down
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def suppressed(boxes: DataFrame, frame: str, order: str, most: float = IOU) -> DataFrame:
    """(frame, slot, x, y, w, h, order) of boxes kept greedily by area within a frame; ties by `order`; slots from 0."""
    box = F.struct((-F.col("w") * F.col("h")).alias("rank"), order, "x", "y", "w", "h")
    kind = f"array<struct<rank:double,{order}:{dict(boxes.dtypes)[order]},x:double,y:double,w:double,h:double>>"
    kept = F.aggregate(
        F.sort_array(F.collect_list(box)), F.array().cast(kind),
        lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > most), acc).otherwise(F.concat(acc, F.array(b))),
    )
    return boxes.groupBy(frame).agg(kept.alias("kept")).select(frame, F.posexplode("kept").alias("slot", "b")).select(frame, "slot", "b.x", "b.y", "b.w", "b.h", F.col(f"b.{order}").alias(order))


def overlapped(boxes: DataFrame, targets: DataFrame, frame: str, least: float) -> DataFrame:
    """Boxes with a target in the same frame at IoU of at least `least`."""
    t = targets.select(F.col(frame).alias("_f"), F.struct("x", "y", "w", "h").alias("_t"))
    return boxes.join(t, (boxes[frame] == t["_f"]) & (iou(F.struct(boxes["x"], boxes["y"], boxes["w"], boxes["h"]), F.col("_t")) >= least), "left_semi")


def crop(boxes: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """`boxes` with pixel edges x0, y0, x1, y1, each rounded on its own and kept in the frame; `empty` if nothing is left."""
    x1, y1 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    out = boxes.withColumns({"x0": pixel_edge(F.col("x"), frame_w, frame_w), "y0": pixel_edge(F.col("y"), frame_h, frame_h), "x1": pixel_edge(x1, frame_w, frame_w), "y1": pixel_edge(y1, frame_h, frame_h)})
    return out.withColumn("empty", (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))


def overlay(boxes: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """As `crop`, for drawing: the first edges stay inside of the last pixel."""
    out = crop(boxes, frame_w, frame_h)
    return out.withColumn("x0", F.least("x0", frame_w - 1)).withColumn("y0", F.least("y0", frame_h - 1))


def art_band(height: Column, width: Column) -> tuple[Column, Column, Column, Column]:
    """(row from, row to, column from, column to) of the picture in a crop, truncated; the whole crop if that is empty."""
    r0, r1, c0, c1 = (F.floor(height * 0.12), F.floor(height * 0.62), F.floor(width * 0.08), F.floor(width * 0.92))
    bad = (r1 <= r0) | (c1 <= c0)
    return tuple(F.when(bad, whole).otherwise(part).cast("int") for part, whole in ((r0, F.lit(0)), (r1, height), (c0, F.lit(0)), (c1, width)))
