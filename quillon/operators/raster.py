"""Kernels on raw rasters, one row a frame: numpy over Arrow batches, memory of one frame at a time.

A raster is (width, height, data) with a byte per pixel, row by row.  A frame
whose bytes do not fit its size has null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numeric import is_finite

PROXY = 32
DESCRIPTOR = 32


def image(width: int, height: int, data: bytes, channels: int = 1) -> np.ndarray | None:
    if data is None or width <= 0 or height <= 0 or len(data) != width * height * channels:
        return None
    shape = (height, width) if channels == 1 else (height, width, channels)
    return np.frombuffer(data, np.uint8).reshape(shape)


def _shift(x: np.ndarray) -> np.ndarray:
    """The nine neighbours of every pixel, zero beyond the border: (3, 3, h, w)."""
    p = np.pad(x, 1)
    h, w = x.shape
    return np.array([[p[i : i + h, j : j + w] for j in range(3)] for i in range(3)])


def gaussian3(x: np.ndarray) -> np.ndarray:
    """3 x 3 binomial smoothing over sixteen, rounded down; a pixel on the border is zero."""
    kernel = np.outer([1, 2, 1], [1, 2, 1])
    out = (np.einsum("ij,ijhw->hw", kernel, _shift(x.astype(np.int64))) // 16).astype(np.uint8)
    out[[0, -1], :] = 0
    out[:, [0, -1]] = 0
    return out


def inside_circle(height: int, width: int, ratio: float = 0.49, margin: int = 2) -> np.ndarray:
    """Pixels whose centres lie in the circle of ``ratio`` times the short side, off the border by ``margin``."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    r = ratio * min(width, height)
    ok = (x - width / 2) ** 2 + (y - height / 2) ** 2 <= r * r
    edge = np.zeros((height, width), bool)
    edge[margin : height - margin, margin : width - margin] = True
    return ok & edge


def sharpness(x: np.ndarray) -> float:
    """Root of the Laplacian's variance plus root of the mean squared gradient, in the valid circle; below 5 pixels 0."""
    ok = inside_circle(*x.shape)
    if ok.sum() < 5:
        return 0.0
    n = _shift(gaussian3(x).astype(float))
    laplace = n[0, 1] + n[2, 1] + n[1, 0] + n[1, 2] - 4 * n[1, 1]
    gx = n[0, 2] + 2 * n[1, 2] + n[2, 2] - n[0, 0] - 2 * n[1, 0] - n[2, 0]
    gy = n[2, 0] + 2 * n[2, 1] + n[2, 2] - n[0, 0] - 2 * n[0, 1] - n[0, 2]
    l, t = laplace[ok], (gx * gx + gy * gy)[ok]
    return float(np.sqrt(max((l * l).mean() - l.mean() ** 2, 0)) + np.sqrt(t.mean()))


def block_means(x: np.ndarray, n: int = PROXY) -> np.ndarray:
    """Whole-number means of n x n blocks that cover the raster; small rasters repeat pixels."""
    h, w = x.shape
    rows = [(i * h // n, max((i + 1) * h // n, i * h // n + 1)) for i in range(n)]
    cols = [(j * w // n, max((j + 1) * w // n, j * w // n + 1)) for j in range(n)]
    total = np.pad(x.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return np.array(
        [[(total[b, d] - total[a, d] - total[b, c] + total[a, c]) // ((b - a) * (d - c)) for c, d in cols] for a, b in rows]
    )


def gradient_proxy(x: np.ndarray, n: int = PROXY) -> np.ndarray:
    """Block means of the gradient's size: unlike brightness, it does not follow the exposure."""
    f = x.astype(np.int64)
    gx, gy = np.zeros_like(f), np.zeros_like(f)
    gx[:, 1:-1] = f[:, 2:] - f[:, :-2]
    gy[1:-1, :] = f[2:, :] - f[:-2, :]
    return block_means(np.minimum((np.abs(gx) + np.abs(gy)) // 2, 255), n)


def resize_limit(width: int, height: int, limit: int = 512) -> tuple[int, int]:
    """Size with the long side at the limit, never enlarged, one pixel at least."""
    long = max(width, height)
    if long <= limit:
        return width, height
    return max(1, round(width * limit / long)), max(1, round(height * limit / long))


def resize_nearest(x: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = x.shape[:2]
    return x[np.arange(height) * h // height][:, np.arange(width) * w // width]


def global_descriptor(x: np.ndarray, n: int = DESCRIPTOR) -> np.ndarray | None:
    """Standardised brightness and both gradients of an n x n thumbnail as one unit vector; null if it is uniform."""
    t = block_means(x, n).astype(float)
    sd = t.std()
    if sd <= 1e-12:
        return None
    z = (t - t.mean()) / sd
    gx, gy = np.zeros_like(z), np.zeros_like(z)
    gx[:, 1:-1] = (z[:, 2:] - z[:, :-2]) / 2
    gy[1:-1, :] = (z[2:, :] - z[:-2, :]) / 2
    v = np.stack([z, gx, gy], axis=-1).ravel()
    return v / np.linalg.norm(v)


def letterbox(width: int, height: int, side: int) -> tuple[float, int, int, int, int]:
    """Scale, left, top, content width and height of a raster fitted into a square."""
    scale = min(side / width, side / height)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    return scale, (side - w) // 2, (side - h) // 2, w, h


def letterbox_planes(x: np.ndarray, side: int, fill: int = 114) -> np.ndarray:
    """Channel planes in 0 .. 1 of an RGB raster in a square, the rest grey."""
    _, left, top, w, h = letterbox(x.shape[1], x.shape[0], side)
    out = np.full((side, side, 3), fill, np.uint8)
    out[top : top + h, left : left + w] = resize_nearest(x, w, h)
    return out.transpose(2, 0, 1).astype(np.float32) / 255


def standardise_planes(x: np.ndarray, mean=(0.485, 0.456, 0.406), sd=(0.229, 0.224, 0.225)) -> np.ndarray:
    return ((x.astype(np.float32) / 255 - mean) / sd).transpose(2, 0, 1).astype(np.float32)


def boxes_to_mask(prototypes: np.ndarray, coefficients: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Union of detections' masks: coefficients times prototypes, positive, within each box (in prototype pixels)."""
    _, h, w = prototypes.shape
    out = np.zeros((h, w), bool)
    for c, (x0, y0, x1, y1) in zip(coefficients, boxes):
        a, b = max(0, int(np.floor(y0))), min(h, int(np.ceil(y1)))
        l, r = max(0, int(np.floor(x0))), min(w, int(np.ceil(x1)))
        if a < b and l < r:
            out[a:b, l:r] |= np.tensordot(c, prototypes[:, a:b, l:r], axes=1) > 0
    return out


def sky_mask(scores: np.ndarray) -> np.ndarray:
    """Scores stretched to 0 .. 1; a half or more is sky, none if all scores are equal."""
    low, high = float(scores.min()), float(scores.max())
    if high - low <= 1e-12:
        return np.zeros(scores.shape, bool)
    return (scores - low) / (high - low) >= 0.5


def keep_mask(valid: np.ndarray, excluded: list[np.ndarray]) -> np.ndarray:
    """255 where a pixel is to be left out: outside the valid region or in an excluded mask, resized to fit."""
    out = np.where(valid, 0, 255).astype(np.uint8)
    for mask in excluded:
        out[resize_nearest(mask, out.shape[1], out.shape[0]) > 0] = 255
    return out


def valid_region(width: int, height: int, ratio: float, curve: list[tuple[float, float]] | None = None) -> np.ndarray:
    """Pixels in the circle and, where the curve has a height, above it (curve as ratios of the sides)."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    r = ratio * min(width, height)
    ok = (x - width / 2) ** 2 + (y - height / 2) ** 2 <= r * r
    if curve:
        xs, ys = np.array(sorted(curve)).T
        at = np.interp(x / width, xs, ys, left=np.nan, right=np.nan)
        ok &= np.isnan(at) | (y / height <= at)
    return ok


def box_iou(a, b) -> float:
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    common = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def suppress(boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, iou: float = 0.45, most: int = 300) -> list[int]:
    """Greedy choice by score: a box goes if it overlaps a chosen one of its class by more than ``iou``."""
    kept: list[int] = []
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        if len(kept) >= most:
            break
        if all(classes[i] != classes[k] or box_iou(boxes[i], boxes[k]) <= iou for k in kept):
            kept.append(int(i))
    return kept


def non_max_suppression(detections: DataFrame, by: list[str], iou: float = 0.45, most: int = 300) -> DataFrame:
    """Detections (by, pos, box, score, class_id) that survive, with their rank; an image's detections are one task's."""
    schema = ", ".join(f"{c} {dict(detections.dtypes)[c]}" for c in [*by, "pos"]) + ", rank int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        boxes = np.array(pdf["box"].tolist(), float).reshape(-1, 4)
        kept = suppress(boxes, pdf["score"].to_numpy(float), pdf["class_id"].to_numpy(), iou, most)
        return pdf.loc[kept, [*by, "pos"]].assign(rank=range(1, len(kept) + 1))

    return detections.groupBy(*by).applyInPandas(run, schema)


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray], object], out: str, kind: str) -> DataFrame:
    """``frames`` (width, height, data, ...) with a kernel's result instead of the data."""
    keep = [c for c in frames.columns if c != "data"]
    schema = ", ".join(f"{c} {t}" for c, t in frames.dtypes if c != "data") + f", {out} {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for w, h, data in zip(pdf["width"], pdf["height"], pdf["data"]):
                x = image(int(w), int(h), data)
                y = None if x is None else kernel(x)
                if isinstance(y, np.ndarray):
                    y = y.astype(np.uint8).tobytes() if kind == "binary" else y.ravel().tolist()
                found.append(y)
            yield pdf[keep].assign(**{out: pd.Series(found, index=pdf.index, dtype=object if kind != "double" else None)})

    return frames.mapInPandas(run, schema)


def tile_means(pixels: DataFrame, by: list[str], tile: int) -> DataFrame:
    """Whole-number means of square tiles of (by, x, y, value) rows, as a plain aggregate."""
    at = [F.floor(F.col(c) / tile).alias(f"tile_{c}") for c in "xy"]
    mean = F.call_function("div", F.sum("value").cast("long"), F.count(F.lit(1)))
    return pixels.groupBy(*by, *at).agg(mean.alias("mean"))


def class_ids(names: list[str], targets: list[str]) -> list[int]:
    """Numbers of the classes that are asked for by name; none, not all, if no name is known."""
    wanted = {t.strip().lower() for t in targets} - {""}
    return [i for i, n in enumerate(names) if n in wanted]


def decode_detections(rows: DataFrame, names: list[str], targets: list[str], confidence: float) -> DataFrame:
    """Rows with class_id, score and corner box of the best class that is asked for (the first of equals).

    ``box`` is centre and size, ``scores`` a score for each class; rows whose
    box is not finite or has no area, or whose score is too low, are dropped.
    """
    ids = class_ids(names, targets)
    if not ids:
        none = rows.limit(0).withColumns({"class_id": F.lit(0), "score": F.lit(0.0)})
        return none
    best = F.lit(None).cast("struct<score:double,class_id:int>")
    for i in ids:
        score = F.get("scores", F.lit(i)).cast("double")
        own = F.struct(score.alias("score"), F.lit(i).alias("class_id"))
        best = F.when(~F.isnan(score) & (best.isNull() | (score > best["score"])), own).otherwise(best)
    x, y, w, h = (F.get("box", F.lit(i)) for i in range(4))
    ok = F.forall("box", is_finite) & (F.size("box") == 4) & (w > 0) & (h > 0)
    out = rows.withColumn("_best", best).filter(ok & is_finite(F.col("_best.score")) & (F.col("_best.score") >= confidence))
    corners = F.array(x - w / 2, y - h / 2, x + w / 2, y + h / 2)
    return out.withColumns({"class_id": F.col("_best.class_id"), "score": F.col("_best.score"), "box": corners}).drop("_best")


def no_mask(x: np.ndarray) -> float:
    """An engine that masks nothing."""
    return 0.0


def threshold_mask(x: np.ndarray, above: int = 127) -> float:
    """An engine that masks what is bright: its number of pixels."""
    return float((x > above).sum())


def limited_size(width, height, limit: int = 512):
    """As :func:`resize_limit`, of columns."""
    longest = F.greatest(width, height)
    fit = lambda n: F.when(longest <= limit, n).otherwise(F.greatest(F.lit(1), F.round(n * F.lit(float(limit)) / longest).cast("int")))
    return fit(width), fit(height)
