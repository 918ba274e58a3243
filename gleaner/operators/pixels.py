"""Kernels over decoded pixels: the steps of the localizer that have no column expression.

They take and give numpy arrays; `candidate_boxes` runs them over a table of frames, after which
everything is columns again and the pixels are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0 .. 179, saturation and value 0 .. 255 of a blue-green-red image."""
    x = bgr.astype(np.float64)
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.where(v > low, v - low, 1)
    hue = np.select([v == r, v == g], [(g - b) / span, 2 + (b - r) / span], 4 + (r - g) / span) * 30
    out = np.stack([np.where(v > low, hue % 180, 0), np.where(v > 0, 255 * (v - low) / np.maximum(v, 1), 0), v], axis=-1)
    return np.rint(out).astype(np.int32) % np.array([180, 256, 256])


def card_mask(image: np.ndarray) -> np.ndarray:
    """Pixels of card colours outside of the fixed screen strips and corners (fixed values).

    Hues are told only where the strips end and the colour is neither too dark nor too pale for any of them.
    """
    rows, cols = image.shape[:2]
    inner = np.s_[int(0.09 * rows) : int(0.86 * rows), int(0.13 * cols) : int(0.92 * cols)]
    part = image[inner]
    b, g, r = part[..., 0], part[..., 1], part[..., 2]
    most = np.maximum(np.maximum(b, g), r).astype(np.int32)
    maybe = (most > 55) & (255 * (most - np.minimum(np.minimum(b, g), r)) >= 40 * most)
    h, s, v = np.moveaxis(hsv(part[maybe]), -1, 0)
    colours = (
        ((h > 128) & (h < 175) & (s > 40) & (v > 65))
        | ((h > 7) & (h < 23) & (s > 65) & (v > 55))
        | (((h > 168) | (h < 6)) & (s > 55) & (v > 55))
        | ((s > 45) & (v > 85))
    )
    out = np.zeros((rows, cols), bool)
    out[inner][maybe] = colours
    out[: int(0.27 * rows), : int(0.27 * cols)] = False
    out[: int(0.36 * rows), int(0.84 * cols) :] = False
    return out


def _spread(mask: np.ndarray, k: int, grow: bool) -> np.ndarray:
    """Running maximum (grow) or minimum over a k x k rectangle, by runs of doubled length; outside counts as what changes nothing."""
    join = np.logical_or if grow else np.logical_and
    before, after = k // 2, k - 1 - k // 2
    for _ in (0, 1):
        wide = np.full((len(mask) + k - 1, mask.shape[1]), not grow)
        wide[before : len(wide) - after] = mask
        have = 1
        while have < k:
            step = min(have, k - have)
            wide = join(wide[:-step], wide[step:])
            have += step
        mask = wide.T
    return mask


def closed_opened(mask: np.ndarray) -> np.ndarray:
    """Close gaps, then drop specks; kernels follow the smaller side."""
    side = min(mask.shape)
    close, small = max(9, int(0.018 * side)), max(3, int(0.006 * side))
    mask = _spread(_spread(mask, close, True), close, False)
    return _spread(_spread(mask, small, False), small, True)


def component_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of the 8-connected components, in order of y, then x; by union of the runs of neighbouring rows."""
    parent: list[int] = []
    box: list[list[int]] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    rows, cols = mask.shape
    wide = np.zeros((rows, cols + 2), np.int8)
    wide[:, 1:-1] = mask
    edges = np.flatnonzero(np.diff(wide.ravel())).reshape(-1, 2)
    above: list[tuple[int, int, int]] = []
    now: list[tuple[int, int, int]] = []
    last = -1
    for y, a, b in zip((edges[:, 0] // (cols + 2)).tolist(), *(edges % (cols + 2)).T.tolist(), strict=True):
        if y != last:
            above, now, last = (now if y == last + 1 else []), [], y
        k = len(parent)
        parent.append(k)
        box.append([a, y, b, y + 1])
        for pa, pb, p in above:
            if pa <= b and pb >= a:
                parent[root(p)] = root(k)
        now.append((a, b, k))
    merged: dict[int, list[int]] = {}
    for k, (a, y, b, y1) in enumerate(box):
        m = merged.setdefault(root(k), [a, y, b, y1])
        m[:] = [min(m[0], a), min(m[1], y), max(m[2], b), max(m[3], y1)]
    return sorted(((a, y, b - a, y1 - y) for a, y, b, y1 in merged.values()), key=lambda t: (t[1], t[0]))


def candidate_boxes(frames: DataFrame, frame: str) -> DataFrame:
    """frames (frame, w, h, pixels: blue-green-red bytes) -> (frame, frame_w, frame_h, x, y, w, h): boxes as fractions, before any geometry filter.

    Rows whose bytes do not fit w and h give no boxes.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, w, h, pixels in zip(batch[frame], batch["w"], batch["h"], batch["pixels"], strict=True):
                if pixels is None or len(pixels) != w * h * 3 or not w * h:
                    continue
                image = np.frombuffer(pixels, np.uint8).reshape(h, w, 3)
                rows += [(key, w, h, x / w, y / h, bw / w, bh / h) for x, y, bw, bh in component_boxes(closed_opened(card_mask(image)))]
            yield pd.DataFrame(rows, columns=[frame, "frame_w", "frame_h", "x", "y", "w", "h"])

    kind = dict(frames.dtypes)[frame]
    return frames.select(frame, "w", "h", "pixels").mapInPandas(find, f"{frame} {kind}, frame_w int, frame_h int, x double, y double, w double, h double")


def thumbnail_cells(image: np.ndarray, rows: int = 8, cols: int = 9) -> np.ndarray:
    """Mean grey of each cell of a rows x cols grid, by area."""
    grey = np.rint(image.astype(np.float64) @ np.array([0.114, 0.587, 0.299])) if image.ndim == 3 else image.astype(np.float64)

    def shares(n: int, k: int) -> np.ndarray:
        edge = np.arange(k + 1) * n / k
        pixel = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], pixel + 1) - np.maximum(edge[:-1, None], pixel), 0, 1) * k / n

    return shares(grey.shape[0], rows) @ grey @ shares(grey.shape[1], cols).T


def _images(batch: pd.DataFrame, w: str, h: str, pixels: str) -> Iterator[np.ndarray | None]:
    for bw, bh, raw in zip(batch[w], batch[h], batch[pixels], strict=True):
        fits = raw is not None and bw * bh > 0 and len(raw) == bw * bh * 3
        yield np.frombuffer(raw, np.uint8).reshape(int(bh), int(bw), 3) if fits else None


def grey_image(image: np.ndarray) -> np.ndarray:
    return np.rint(image.astype(np.float64) @ np.array([0.114, 0.587, 0.299]))


def frame_stats(frames: DataFrame, frame: str) -> DataFrame:
    """frames (frame, w, h, pixels) -> (frame, w, h, mean, center, ring, red): what the gate and the tint test look at; nulls where bytes do not fit."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, bw, bh, image in zip(batch[frame], batch["w"], batch["h"], _images(batch, "w", "h", "pixels"), strict=True):
                if image is None:
                    rows.append((key, bw, bh, None, None, None, None))
                    continue
                g = grey_image(image)
                h, w = g.shape
                # Grey is whole numbers: sums are exact, and the ring is what the box leaves of the outer part.
                box = g[int(h * 0.3) : int(h * 0.7), int(w * 0.3) : int(w * 0.7)]
                outer = g[int(h * 0.1) : int(h * 0.9), int(w * 0.1) : int(w * 0.9)]
                n = outer.size - box.size
                x = image.astype(np.int32)
                rows.append((key, bw, bh, g.mean(), box.mean() if box.size else None, max((outer.sum() - box.sum()) / n, 1.0) if n else 1.0, float((x[..., 2] - np.maximum(x[..., 0], x[..., 1])).mean())))
            yield pd.DataFrame(rows, columns=[frame, "w", "h", "mean", "center", "ring", "red"])

    kinds = dict(frames.dtypes)
    return frames.select(frame, "w", "h", "pixels").mapInPandas(measure, f"{frame} {kinds[frame]}, w {kinds['w']}, h {kinds['h']}, mean double, center double, ring double, red double")


def crops(frames: DataFrame, boxes: DataFrame, frame: str) -> DataFrame:
    """boxes (frame, slot, x, y, w, h) with crop_w, crop_h and `crop`, the bytes; edges are rounded by themselves; an empty crop has none."""
    met = boxes.join(frames.select(frame, F.col("w").alias("frame_w"), F.col("h").alias("frame_h"), "pixels"), frame)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y, w, h, image in zip(batch["x"], batch["y"], batch["w"], batch["h"], _images(batch, "frame_w", "frame_h", "pixels"), strict=True):
                if image is None:
                    out.append((0, 0, None))
                    continue
                fh, fw, _ = image.shape
                x0, x1 = (int(np.clip(np.rint(v * fw), 0, fw)) for v in (x, x + w))
                y0, y1 = (int(np.clip(np.rint(v * fh), 0, fh)) for v in (y, y + h))
                part = image[y0:y1, x0:x1]
                out.append((part.shape[1], part.shape[0], part.tobytes()) if part.size else (0, 0, None))
            cw, ch, raw = zip(*out, strict=True) if out else ((), (), ())
            yield batch.drop(columns=["frame_w", "frame_h", "pixels"]).assign(crop_w=cw, crop_h=ch, crop=raw)

    kinds = ", ".join(f"`{c}` {k}" for c, k in met.drop("frame_w", "frame_h", "pixels").dtypes)
    return met.mapInPandas(cut, f"{kinds}, crop_w int, crop_h int, crop binary")


def histogram_image(image: np.ndarray) -> np.ndarray:
    """Shares of 32 x 16 hue-saturation bins among pixels with s > 25 and 30 < v < 250; zeros if there are none."""
    h, s, v = np.moveaxis(hsv(image), -1, 0)
    mask = (s > 25) & (v > 30) & (v < 250)
    counts = np.bincount((h[mask] * 32 // 180) * 16 + s[mask] * 16 // 256, minlength=512).astype(np.float64)
    return counts / max(counts.sum(), 1)


def art_histograms(pictures: DataFrame, w: str, h: str, pixels: str, band: bool = True) -> DataFrame:
    """`pictures` with `vector` for their pixels: the histogram of the art band, or of all of them, less its mean, of length 1 (zeros if flat), so that a dot product is a correlation."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = []
            for image in _images(batch, w, h, pixels):
                if image is None:
                    vectors.append([0.0] * 512)
                    continue
                rows, cols = image.shape[:2]
                art = image[int(rows * 0.12) : int(rows * 0.62), int(cols * 0.08) : int(cols * 0.92)] if band else image
                x = histogram_image(art if art.size else image)
                x = x - x.mean()
                norm = float(np.linalg.norm(x))
                vectors.append((x / norm if norm > 1e-9 else np.zeros(512)).tolist())
            yield batch.drop(columns=[pixels]).assign(vector=vectors)

    kinds = ", ".join(f"`{c}` {k}" for c, k in pictures.drop(pixels).dtypes)
    return pictures.mapInPandas(measure, f"{kinds}, vector array<double>")


def reference_image(raw: bytes, w: int, h: int, channels: int) -> np.ndarray:
    """A reference picture: alpha composed onto white, grey as three channels, the upper 80 % of the rows (one at least)."""
    image = np.frombuffer(raw, np.uint8).reshape(h, w, channels).astype(np.float64)
    if channels == 4:
        alpha = image[..., 3:] / 255
        image = image[..., :3] * alpha + 255 * (1 - alpha)
    elif channels == 1:
        image = np.repeat(image, 3, axis=-1)
    return image[: max(1, int(h * 0.8))].astype(np.uint8)


def references(pictures: DataFrame) -> DataFrame:
    """pictures (..., w, h, n_channels, pixels) as references: the same columns less n_channels, three channels each."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [reference_image(raw, int(w), int(h), int(c)) for w, h, c, raw in zip(batch["w"], batch["h"], batch["n_channels"], batch["pixels"], strict=True)]
            yield batch.drop(columns=["n_channels"]).assign(h=[x.shape[0] for x in found], pixels=[x.tobytes() for x in found])

    kinds = ", ".join(f"`{c}` {k}" for c, k in pictures.drop("n_channels").dtypes)
    return pictures.mapInPandas(load, kinds)


#: Side, means and deviations of red, green and blue that image models are fed with.
MODEL_SIDE, MODEL_MEAN, MODEL_STD = 224, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def model_input(image: np.ndarray, side: int = MODEL_SIDE) -> np.ndarray:
    """A blue-green-red picture as a 3 x side x side array: red-green-blue, bilinear, normalised."""

    def weights(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = at.astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    x = image[..., ::-1].astype(np.float64)
    (y0, y1, fy), (x0, x1, fx) = weights(x.shape[0]), weights(x.shape[1])
    rows = x[y0] * (1 - fy)[:, None, None] + x[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return ((out / 255 - np.array(MODEL_MEAN)) / np.array(MODEL_STD)).transpose(2, 0, 1).astype(np.float32)
