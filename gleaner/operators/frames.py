"""Frame selection: strides, last-kept dedup, thinning, state gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.scalar import gradient_hash, stride_for_fps, timestamp_of
from gleaner.operators.orbit import GROUP_ROWS, Apart, last_kept

NEAR_BITS = 8
BRIGHT, RATIO, RED = 160.0, 2.0, 10.0
BINS = 512


def strided(frames: DataFrame, media_fps: Column, target_fps: Column, index: str = "frame_index") -> DataFrame:
    """Every stride-th frame, with `stride` and `timestamp_s`."""
    stride = stride_for_fps(media_fps, target_fps)
    return frames.withColumn("stride", stride).where(F.col(index) % F.col("stride") == 0).withColumn("timestamp_s", timestamp_of(F.col(index), media_fps))


#: Cells of a thumbnail that a picture's hash is made of: nine columns give eight differences a row.
THUMB_COLS, THUMB_ROWS = 9, 8


def cell_shares(at: Column, size: Column, cells: int) -> Column:
    """(cell, weight) of the `cells` equal parts of `size` pixels that pixel `at` reaches into; weights are whole numbers, a pixel's add up to `cells`."""
    first, last = F.floor(at * cells / size), F.ceil((at + 1) * cells / size) - 1
    weight = lambda k: F.least((at + 1) * cells, (k + 1) * size) - F.greatest(at * cells, k * size)
    share = lambda k: F.struct(k.alias("cell"), weight(k).cast("long").alias("weight"))
    # A pixel that is no wider than a cell lies in one of them or two.
    narrow = F.when(first == last, F.array(share(first))).otherwise(F.array(share(first), share(last)))
    return F.when(size >= cells, narrow).otherwise(F.transform(F.sequence(first, last), share))


def picture_hashes(pixels: DataFrame, by: str, w: Column, h: Column, cols: int = THUMB_COLS, rows: int = THUMB_ROWS) -> DataFrame:
    """pixels (by, x, y, v) of pictures of w x h -> (by, dhash): 64 bits of brightness differences of an area-resized thumbnail.

    A pixel on the edge of cells counts to each by the area that it has there; sums are of whole
    numbers if `v` is, so that equal cells are equal. A cell without pixels is 0. Pixels are summed
    before they are shuffled: a picture is `cols` x `rows` rows then, whatever its size. Pixels
    outside of the picture, or without a value, are not looked at.
    """
    inside = pixels.where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h) & F.col("v").isNotNull())
    wide = inside.select(by, "y", "v", h.alias("_h"), F.inline(cell_shares(F.col("x"), w, cols))).withColumnsRenamed({"cell": "_col", "weight": "_wx"})
    both = wide.select(by, "v", "_col", "_wx", F.inline(cell_shares(F.col("y"), F.col("_h"), rows)))
    area = F.col("_wx") * F.col("weight")
    cells = both.groupBy(by, "_col", "cell").agg((F.sum(area * F.col("v")) / F.sum(area)).alias("_mean"))
    known = cells.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct((F.col("cell") * cols + F.col("_col")).cast("int").alias("k"), F.col("_mean").cast("double").alias("m")))).alias("_cells"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(cols * rows - 1)), lambda k: F.coalesce(F.try_element_at("_cells", k), F.lit(0.0)))
    return known.select(by, gradient_hash(grid, rows, cols - 1).alias("dhash"))


def far(threshold: int) -> Apart:
    """Whether 64-bit hashes differ from one in more than `threshold` bits."""
    return lambda a, b: np.bitwise_count(np.bitwise_xor(np.asarray(a, np.int64), np.int64(b)).view(np.uint64)) > threshold


def later(seconds: float) -> Apart:
    """Whether times are at least `seconds` after one."""
    return lambda a, b: a - b >= seconds


def dedup_last_kept(rows: DataFrame, by: str, order: list[str], hash_col: str = "dhash", threshold: int = NEAR_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`rows` with `kept`: over `threshold` bits from the last kept hash of the group, see `orbit.last_kept`. `order` must be total. Pass slim rows: all columns are sorted."""
    return last_kept(rows, by, order, hash_col, far(threshold), group_rows)


def thinned(rows: DataFrame, by: str, order: list[str], seconds: str, max_fps: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`rows` with `kept`: at least 1 / max_fps after the last kept row of the group."""
    return last_kept(rows, by, order, seconds, later(1.0 / max_fps), group_rows)


def select_frames(frames: DataFrame, by: str, order: list[str], threshold: int = NEAR_BITS, state: str = "board") -> DataFrame:
    """Frames (by, order..., dhash, state) that are kept by dedup and in `state`.

    Dedup comes first: a kept frame of another state still is what later ones are compared with.
    """
    return dedup_last_kept(frames, by, order, "dhash", threshold).where(F.col("kept") & (F.col("state") == state)).drop("kept")


def first_of(rows: DataFrame, by: str | None, order: list[str], most: int) -> DataFrame:
    """The first `most` rows in order, of each group or, without `by`, of all; not above 0: all rows."""
    if most <= 0:
        return rows
    if by is None:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_i") <= most).drop("_i")


def region_stats(pixels: DataFrame, by: str, w: Column, h: Column) -> DataFrame:
    """pixels (by, x, y, v) -> (by, mean, center, ring): centre box 30-70 %, ring 10-90 % without it, at least 1."""
    inside = lambda a, b: (F.col("x") >= F.floor(w * a)) & (F.col("x") < F.floor(w * b)) & (F.col("y") >= F.floor(h * a)) & (F.col("y") < F.floor(h * b))
    center, outer = inside(0.3, 0.7), inside(0.1, 0.9)
    return pixels.groupBy(by).agg(F.avg("v").alias("mean"), F.avg(F.when(center, F.col("v"))).alias("center"), F.greatest(F.avg(F.when(outer & ~center, F.col("v"))), F.lit(1.0)).alias("ring"))


def gate(mean: Column, center: Column, ring: Column) -> Column:
    """menu if bright, else modal if the centre outshines the ring, else board; a missing or NaN ratio is a board."""
    ratio = F.try_divide(center, ring)
    return F.when(mean >= BRIGHT, "menu").when(F.coalesce(~F.isnan(ratio) & (ratio >= RATIO), F.lit(False)), "modal").otherwise("board")


def red_shift(pixels: DataFrame, by: str) -> DataFrame:
    """(by, red_shift, tinted): mean of red less the larger of green and blue."""
    return pixels.groupBy(by).agg(F.avg(F.col("r") - F.greatest("g", "b")).alias("red_shift")).withColumn("tinted", F.col("red_shift") >= RED)


def hs_histogram(pixels: DataFrame, by: str) -> DataFrame:
    """(by, bin, share): 32 x 16 hue-saturation bins of pixels with s > 25 and 30 < v < 250; shares of a frame sum to 1; empty bins are left out."""
    masked = pixels.where("s > 25 and v > 30 and v < 250").select(by, (F.floor(F.col("hue") * 32 / 180) * 16 + F.floor(F.col("s") * 16 / 256)).cast("int").alias("bin"))
    counts = masked.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).select(by, "bin", (F.col("n") / F.col("total")).alias("share"))


def histogram_vectors(histograms: DataFrame, by: str, bins: int = BINS) -> DataFrame:
    """histograms (by, bin, share) -> (by, vector): all bins, less their mean and of length 1, so that a dot product is a Pearson correlation. A flat one: zeros."""
    share = F.col("share")
    filled = histograms.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m"), (F.sum(share) / bins).alias("mean"), F.sqrt(F.sum(share * share) - F.sum(share) * F.sum(share) / bins).alias("norm"))
    value = lambda k: (F.coalesce(F.try_element_at("m", k), F.lit(0.0)) - F.col("mean")) / F.col("norm")
    return filled.select(by, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.when(F.col("norm") > 1e-9, value(k)).otherwise(0.0)).alias("vector"))
