"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P**2, null for no perimeter."""
    return 4 * 3.141592653589793 * area / F.nullif(perimeter * perimeter, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """F16."""
    return 1 / (1 + F.exp(-x))


def grayscale(v: Column, contrast, brightness, log_gamma) -> Column:
    """clip(v * contrast + brightness, 0, 1) ** (2 ** log_gamma)."""
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * contrast + brightness)), F.pow(F.lit(2.0), log_gamma if isinstance(log_gamma, Column) else F.lit(float(log_gamma))))


def bit_depth(v: Column, old_top: float, new_top: int) -> Column:
    """rescaled from one top value to another, cut to whole numbers and never wrapped."""
    return F.least(F.lit(new_top), F.greatest(F.lit(0), F.floor(v * new_top / old_top))).cast("int")


def interpolate(x: Column, table: list[tuple[float, float]]) -> Column:
    """piecewise linear through (x, y) points in rising order of x, held at the ends."""
    (x0, y0), last = table[0], table[-1]
    out = F.when(x <= x0, F.lit(float(y0)))
    for (a, ya), (b, yb) in zip(table, table[1:]):
        out = out.when(x <= b, F.lit(float(ya)) + (x - a) * (yb - ya) / (b - a))
    return out.otherwise(F.lit(float(last[1])))


def mean_radius(cy: Column, cx: Column, points: Column) -> Column:
    """mean distance from a centre to an array of (y, x) points; null for none."""
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + F.sqrt((p["y"] - cy) * (p["y"] - cy) + (p["x"] - cx) * (p["x"] - cx)))
    return total / F.nullif(F.size(points), F.lit(0))


def chunk_of(index: Column, chunks: int, n: int) -> Column:
    """which of `chunks` nearly equal ranges of 0 to n - 1 an index is in."""
    return F.floor(index * chunks / n).cast("int")


def polygon_area(points: Column) -> Column:
    """Area inside an array of (y, x) corners."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_perimeter(points: Column) -> Column:
    """Length around an array of (y, x) corners."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))), F.lit(0.0), lambda s, v: s + v)


def contour_filter(area: Column, circle: Column, intensity: Column, area_between: tuple[float, float], circle_above: float, intensity_above: Column, scale_x: float = 1.0, scale_y: float = 1.0) -> Column:
    """All bounds are strict; the smallest area is divided by the x scale, the largest by the y scale."""
    return (area > area_between[0] / scale_x) & (area < area_between[1] / scale_y) & (circle > circle_above) & (intensity > intensity_above)
