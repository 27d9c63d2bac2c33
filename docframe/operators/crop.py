"""Crop windows: ratio and gravity as column arithmetic, saliency by summed areas in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of edges, saturation, skin tones and nearness to the centre; the greatest gradient; the skin box in Cb and Cr; candidates a side
WEIGHTS = {"edge": 1.0, "saturation": 0.3, "skin": 0.5, "center": 0.3}
GRADIENT, SKIN, STEPS = 1020.0, ((77, 133), (133, 177)), 16


def fit_window(width: Column, height: Column, w: Column, h: Column) -> Column:
    """struct(x, y): the largest window of ratio w to h within width x height, one pixel at least."""
    wider = width * h > w * height
    x = F.when(wider, F.floor(height * w / h)).otherwise(width)
    y = F.when(wider, height).otherwise(F.floor(width * h / w))
    return F.struct(F.greatest(F.least(x, width), F.lit(1)).cast("int").alias("x"), F.greatest(F.least(y, height), F.lit(1)).cast("int").alias("y"))


def anchor(width: Column, height: Column, window: Column, gravity: Column) -> Column:
    """struct(x0, y0, x1, y1): the window at a side (north, south, west, east), centred along the rest."""
    dx, dy = width - window["x"], height - window["y"]
    x = F.when(gravity == "west", 0).when(gravity == "east", dx).otherwise(F.floor(dx / 2)).cast("int")
    y = F.when(gravity == "north", 0).when(gravity == "south", dy).otherwise(F.floor(dy / 2)).cast("int")
    return F.struct(x.alias("x0"), y.alias("y0"), (x + window["x"]).alias("x1"), (y + window["y"]).alias("y1"))


def saliency(rgb: np.ndarray, weights: dict[str, float] | None = None) -> np.ndarray:
    """Scores of an image (height, width, 3): luma gradients inside its border, saturation, skin tones, nearness to the centre."""
    w = WEIGHTS | (weights or {})
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    most, least = rgb.max(axis=-1).astype(float), rgb.min(axis=-1).astype(float)
    score = w["saturation"] * np.divide(most - least, most, out=np.zeros_like(most), where=most > 0)
    cb, cr = -0.169 * r - 0.331 * g + 0.5 * b + 128, 0.5 * r - 0.419 * g - 0.081 * b + 128
    (b0, b1), (r0, r1) = SKIN
    score += w["skin"] * ((cb >= b0) & (cb <= b1) & (cr >= r0) & (cr <= r1))
    if min(luma.shape) > 2:
        smooth = lambda m: m[:-2] + 2 * m[1:-1] + m[2:]
        across, down = luma[:, 2:] - luma[:, :-2], luma[2:] - luma[:-2]
        score[1:-1, 1:-1] += w["edge"] * np.hypot(smooth(across), smooth(down.T).T) / GRADIENT
    height, width = luma.shape
    cy, cx = (height - 1) / 2, (width - 1) / 2
    far = np.hypot(cx, cy)
    if far > 0:
        score += w["center"] * (1 - np.hypot(np.arange(width)[None, :] - cx, np.arange(height)[:, None] - cy) / far)
    return score


def best_window(rgb: np.ndarray, size: tuple[int, int], weights: dict[str, float] | None = None) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the window of greatest mean score; ties go to the centred one, then to the least y and x."""
    height, width = rgb.shape[:2]
    wx, wy = size
    area = np.zeros((height + 1, width + 1))
    area[1:, 1:] = saliency(rgb, weights).cumsum(axis=0).cumsum(axis=1)
    step = max(1, min(wx, wy) // STEPS)
    ys, xs = np.arange(0, height - wy + 1, step), np.arange(0, width - wx + 1, step)
    mean = (area[np.ix_(ys + wy, xs + wx)] - area[np.ix_(ys, xs + wx)] - area[np.ix_(ys + wy, xs)] + area[np.ix_(ys, xs)]) / (wx * wy)
    y0, x0 = (height - wy) // 2, (width - wx) // 2
    seed = (area[y0 + wy, x0 + wx] - area[y0, x0 + wx] - area[y0 + wy, x0] + area[y0, x0]) / (wx * wy)
    k = int(mean.argmax())
    if mean.ravel()[k] > seed:
        y0, x0 = int(ys[k // len(xs)]), int(xs[k % len(xs)])
    return x0, y0, x0 + wx, y0 + wy
