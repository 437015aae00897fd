"""Contours of sections: outlines as polygons, filling of polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.functions.maths import polygon_area, polygon_perimeter
from voxmere.operators.raster import by_volume


def by_section(voxels: DataFrame, function) -> DataFrame:
    """A function from a section's voxels (z, y, x, v) to others, applied to every section of every volume."""
    by = by_volume(voxels)

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf)
        return out.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "z", "y", "x", "v"]]

    return voxels.select(*by, "z", "y", "x", "v").groupBy(*by, "z").applyInPandas(kept, ", ".join([*(f"{c} string" for c in by), "z int, y int, x int, v double"]))


#: The eight steps around a pixel, in turn.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def outline(pixels: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The border of a connected set of (y, x), followed around from its first pixel; straight runs keep their ends only."""
    start = min(pixels)
    path, at, way, first = [start], start, 0, None
    while True:
        for k in range(8):
            turn = (way + 5 + k) % 8
            step = (at[0] + _AROUND[turn][0], at[1] + _AROUND[turn][1])
            if step in pixels:
                break
        else:
            return path
        if at == start and turn == first:  # at the start again and about to leave it as before
            break
        first = turn if first is None else first
        at, way = step, turn
        path.append(at)
    path.pop()
    turned = [p for i, p in enumerate(path) if (p[0] - path[i - 1][0], p[1] - path[i - 1][1]) != (path[(i + 1) % len(path)][0] - p[0], path[(i + 1) % len(path)][1] - p[1])]
    return turned or path[:1]


def pieces_of(pixels: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """The sets of pixels that touch each other by a side or a corner, in order of their first pixel."""
    left, out = set(pixels), []
    while left:
        piece, edge = set(), [min(left)]
        left.discard(edge[0])
        while edge:
            at = edge.pop()
            piece.add(at)
            for dy, dx in _AROUND:
                step = (at[0] + dy, at[1] + dx)
                if step in left:
                    left.discard(step)
                    edge.append(step)
        out.append(piece)
    return out


def contours(labelled: DataFrame) -> DataFrame:
    """(volume_id, label, z, piece, pts, area, perimeter) of the outlines of each object in each plane.

    The corners are pixel centres. An object that is in several pieces in a plane has as many rows there.
    """

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        found = [outline(p) for p in pieces_of(set(zip(pdf["y"].tolist(), pdf["x"].tolist())))]
        return pd.DataFrame({"volume_id": first["volume_id"], "label": int(first["label"]), "z": int(first["z"]), "piece": range(len(found)), "pts": [[{"y": float(y), "x": float(x)} for y, x in points] for points in found]})

    found = labelled.select("volume_id", "label", "z", "y", "x").groupBy("volume_id", "label", "z").applyInPandas(trace, "volume_id string, label long, z int, piece int, pts array<struct<y:double,x:double>>")
    return found.withColumns({"area": polygon_area(F.col("pts")), "perimeter": polygon_perimeter(F.col("pts"))})


def largest_contour(found: DataFrame, least_area: float, scale_y: float = 1.0, scale_x: float = 1.0) -> DataFrame:
    """Each volume's contour with the largest area, none where that is below least_area / (scale_y * scale_x)."""
    top = found.groupBy("volume_id").agg(F.max_by(F.struct(*found.columns), F.struct("area", "label", "z", "piece")).alias("c")).select("c.*")
    return top.where(F.col("area") >= least_area / (scale_y * scale_x))


def filled(polygons: DataFrame) -> DataFrame:
    """The integer pixels inside (z, pts) polygons, by the parity of the edges that a row crosses to their left."""
    after = F.concat(F.slice("pts", 2, F.size("pts")), F.slice("pts", 1, 1))
    by = [*by_volume(polygons), "z"]
    k = [*by, "k"]  # a polygon is known by its points, so a task that is run again finds the same
    named = polygons.select(*by, "pts").distinct().withColumn("k", F.xxhash64("pts"))
    edges = named.select(*k, F.explode(F.arrays_zip(F.col("pts").alias("p"), after.alias("q"))).alias("e")).select(*k, "e.p", "e.q").where("p.y <> q.y")
    lo, hi = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    rows = edges.where(F.ceil(lo) <= F.ceil(hi) - 1).withColumn("y", F.explode(F.sequence(F.ceil(lo), F.ceil(hi) - 1)))
    cross = rows.select(*k, "y", (F.col("p.x") + (F.col("y") - F.col("p.y")) * (F.col("q.x") - F.col("p.x")) / (F.col("q.y") - F.col("p.y"))).alias("x"))
    spans = cross.groupBy(*k, "y").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("i", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int"))))
    ends = spans.select(*k, "y", F.ceil(F.get("xs", F.col("i") * 2)).alias("a"), F.floor(F.get("xs", F.col("i") * 2 + 1)).alias("b")).where("a <= b")
    return ends.select(*by, F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("x")).distinct()


def covered(polygons: DataFrame, *keep: str) -> DataFrame:
    """Runs (keep, y, a, b) of the pixels that (pts) polygons cover, inside and under their outline; runs of a polygon may overlap.

    Between rows an outline is where its edge is nearest: a steep edge has one pixel in a row, a flat one a run.
    """
    after = F.concat(F.slice("pts", 2, F.size("pts")), F.slice("pts", 1, 1))
    edges = polygons.withColumn("k", F.xxhash64("pts", *keep)).select(*keep, "k", F.explode(F.arrays_zip(F.col("pts").alias("p"), after.alias("q"))).alias("e")).select(*keep, "k", "e.p", "e.q")
    lo, hi = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    dy, dx = F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x")
    at = lambda y: F.when(dy == 0, F.col("p.x")).otherwise(F.col("p.x") + (F.greatest(lo, F.least(hi, y)) - F.col("p.y")) * dx / F.nullif(dy, F.lit(0.0)))
    nearest = lambda v: F.floor(v + 0.5)
    inside = edges.where(F.ceil(lo) <= F.ceil(hi) - 1).withColumn("y", F.explode(F.sequence(F.ceil(lo), F.ceil(hi) - 1)))
    crossed = inside.groupBy(*keep, "k", "y").agg(F.array_sort(F.collect_list(at(F.col("y")))).alias("xs"))
    halves = crossed.withColumn("i", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int"))))
    runs = halves.select(*keep, "y", F.ceil(F.get("xs", F.col("i") * 2)).alias("a"), F.floor(F.get("xs", F.col("i") * 2 + 1)).alias("b")).where("a <= b")
    rows = edges.withColumn("y", F.explode(F.sequence(nearest(lo), nearest(hi))))
    steep = F.abs(dx) <= F.abs(dy)
    up, down = F.when(steep, at(F.col("y"))).otherwise(at(F.col("y") - 0.5)), F.when(steep, at(F.col("y"))).otherwise(at(F.col("y") + 0.5))
    flat = dy == 0
    ends = F.when(flat, F.least("p.x", "q.x")).otherwise(F.least(up, down)), F.when(flat, F.greatest("p.x", "q.x")).otherwise(F.greatest(up, down))
    return runs.unionByName(rows.select(*keep, "y", nearest(ends[0]).alias("a"), nearest(ends[1]).alias("b")))


def erase(voxels: DataFrame, polygons: DataFrame) -> DataFrame:
    """Voxels outside the polygons of their plane."""
    return voxels.join(filled(polygons), [*(c for c in by_volume(polygons) if c in voxels.columns), "z", "y", "x"], "left_anti")
