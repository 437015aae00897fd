"""V9: edges of sections as ridges of their gradient, found tile by tile and followed across tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.operators import dense
from voxmere.operators.components import label
from voxmere.operators.raster import by_volume, dilate, gaussian_filter

_REACH = (0, 2, 2)


def ridges(voxels: DataFrame, ydim: int, xdim: int, low: float) -> DataFrame:
    """Pixels whose gradient is at least `low` and not less than those ahead of and behind them along it, with the gradient's size. Beyond a section's border its values go on; the gradient there is 0."""

    def kernel(block: np.ndarray, start: list[int]) -> np.ndarray:
        out = np.full(dense.core(block, _REACH).shape, np.nan)
        rows, columns = (np.arange(n) + s - 2 for n, s in zip(block.shape[1:], start[1:]))
        inside = ((rows >= 0) & (rows < ydim))[:, None] & ((columns >= 0) & (columns < xdim))
        if not inside.any():
            return out
        image = np.where(np.isneginf(block), 0.0, block)[:, np.clip(rows, 0, ydim - 1) - rows[0]][:, :, np.clip(columns, 0, xdim - 1) - columns[0]]
        n, m = (k - 2 for k in image.shape[1:])
        dy = sum(w * (image[:, 2:, j : j + m] - image[:, :-2, j : j + m]) for j, w in ((0, 1), (1, 2), (2, 1)))
        dx = sum(w * (image[:, j : j + n, 2:] - image[:, j : j + n, :-2]) for j, w in ((0, 1), (1, 2), (2, 1)))
        size = np.where(inside[1:-1, 1:-1], np.hypot(dy, dx), 0.0)
        turn = np.round(np.arctan2(dy, dx) / (np.pi / 4)).astype(int)[:, 1:-1, 1:-1] % 4
        inner, keep = size[:, 1:-1, 1:-1], np.zeros(out.shape, bool)
        n, m = inner.shape[1:]
        for t, (a, b) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
            ahead, back = size[:, 1 + a : 1 + a + n, 1 + b : 1 + b + m], size[:, 1 - a : 1 - a + n, 1 - b : 1 - b + m]
            keep |= (turn == t) & (inner >= ahead) & (inner > back)
        keep &= (inner >= low) & inside[2:-2, 2:-2]
        out[keep] = inner[keep]
        return out

    return dense.by_block(in_section(voxels, ydim, xdim), _REACH, kernel, placed=True)


def in_section(voxels: DataFrame, ydim: int, xdim: int) -> DataFrame:
    return voxels.where(F.col("y").between(0, ydim - 1) & F.col("x").between(0, xdim - 1))


def gradient_edges(voxels: DataFrame, ydim: int, xdim: int, low: float, high: float) -> DataFrame:
    """V9: (z, y, x, v) of the ridge pixels that hang together, by sides or corners, with one whose gradient reaches `high`; v is the gradient's size.

    Weak ridges are found in tiles and joined to strong ones as connected components, so an edge may run through any
    number of tiles and no task holds a section.
    """
    by = by_volume(voxels)
    weak = ridges(voxels, ydim, xdim, low)
    section = weak.withColumn("volume_id", F.to_json(F.struct(*by, "z")))
    found = label(section.select("volume_id", "z", "y", "x", "v"), ydim, xdim, 18)
    strong = found.groupBy("volume_id", "label").agg(F.max("v").alias("top")).where(F.col("top") >= high).select("volume_id", "label")
    kept = found.join(strong.hint("merge"), ["volume_id", "label"], "left_semi")
    return kept.select(*(F.get_json_object("volume_id", f"$.{c}").alias(c) for c in by), "z", "y", "x", "v")


def edge_regions(voxels: DataFrame, ydim: int, xdim: int, low: float, high: float, sigma: float = 4.0, size: int = 5) -> DataFrame:
    """V9: edges of the smoothed sections, widened by squares of `size` (odd) pixels; v is 1."""
    smooth = in_section(gaussian_filter(voxels, (0.0, sigma, sigma)), ydim, xdim) if sigma else voxels
    edges = gradient_edges(smooth, ydim, xdim, low, high).withColumn("v", F.lit(1.0))
    return in_section(dilate(edges, (0, size // 2, size // 2)), ydim, xdim)
