"""Overlapping windows over volumes: grids, patches, and putting results together again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmere.operators.raster import by_volume


def patch_grid(spark: SparkSession, shape: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """(patch_id, z0, y0, x0); starts 0, stride, 2 stride ... on each axis, z slowest. The id is arithmetic, not a count of rows."""
    n = [math.ceil(d / s) for d, s in zip(shape, stride)]
    ids = spark.range(n[0] * n[1] * n[2]).select(F.col("id").cast("int").alias("patch_id"))
    return ids.select("patch_id", (F.expr(f"patch_id div {n[1] * n[2]}") * stride[0]).cast("int").alias("z0"), (F.expr(f"patch_id div {n[2]}") % n[1] * stride[1]).cast("int").alias("y0"), (F.col("patch_id") % n[2] * stride[2]).cast("int").alias("x0"))


def patches(voxels: DataFrame, shape: tuple[int, int, int], stride: tuple[int, int, int], window: tuple[int, int, int]) -> DataFrame:
    """Each voxel once in every patch that holds it, with its place in the patch; what a patch lacks counts as 0.

    A voxel computes the starts of its patches, so nothing is joined.
    """
    out, number = voxels, None
    for axis, d, s, w in zip("zyx", shape, stride, window):
        last = (d - 1) // s
        k = F.sequence(F.greatest(F.lit(0), F.ceil((F.col(axis) - w + 1) / s)).cast("int"), F.least(F.lit(last), F.floor(F.col(axis) / s)).cast("int"))
        out = out.where(F.greatest(F.lit(0), F.ceil((F.col(axis) - w + 1) / s)) <= F.least(F.lit(last), F.floor(F.col(axis) / s))).withColumn(f"k{axis}", F.explode(k))
        number = F.col(f"k{axis}") if number is None else number * math.ceil(d / s) + F.col(f"k{axis}")
        out = out.withColumn(f"p{axis}", F.col(axis) - F.col(f"k{axis}") * s)
    return out.withColumn("patch_id", number.cast("int")).drop("kz", "ky", "kx")


def merged_by_max(placed: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Overlapping patches' voxels (z, y, x in the volume) as their maximum; what reaches beyond the volume is cut."""
    return placed.where((F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2])).groupBy(*by_volume(placed), "z", "y", "x").agg(F.max("v").alias("v"))


def scan_starts(dim: int, patch: int, stride: float) -> list[int]:
    """Centres of a forward scan of one axis: stride 0 means no overlap, below 1 a share of the patch; the last patch ends with the axis."""
    step = patch if stride == 0 else math.ceil(stride * patch) if stride < 1 else int(stride)
    first, most = patch // 2, dim - patch + patch // 2
    return sorted({*range(first, most + 1, step), most})


def scan_grid(spark: SparkSession, dims: tuple[int, int, int], patch: tuple[int, int, int], stride: tuple[float, float, float]) -> DataFrame:
    """Centres of all patches of a scan."""
    axes = [spark.createDataFrame([(s,) for s in scan_starts(*a)], f"{n} int") for n, a in zip("zyx", zip(dims, patch, stride))]
    return axes[0].crossJoin(F.broadcast(axes[1])).crossJoin(F.broadcast(axes[2]))


def blended(pushed: DataFrame, weight: str | None = None) -> DataFrame:
    """Overlapping outputs as their (weighted) mean."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pushed.groupBy(*by_volume(pushed), "z", "y", "x").agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))


def overwritten(pushed: DataFrame, order: str) -> DataFrame:
    """The value that was pushed last."""
    return pushed.groupBy(*by_volume(pushed), "z", "y", "x").agg(F.max_by("v", order).alias("v"))


def bump_logit(place: Column, n: int, exponent: float = 1.5) -> Column:
    """One axis of the bump weight's logarithm at place 0 to n - 1 of a window."""
    u = (place + 1) / F.lit(float(n + 1))
    return -F.pow(u * (1 - u), F.lit(-exponent))


def bump_blended(placed: DataFrame, window: tuple[int, int, int], exponent: float = 1.5) -> DataFrame:
    """Mean of overlapping windows with smooth weights; logarithms are taken relative to a voxel's largest, so nothing underflows.

    placed has z, y, x, v and the places pz, py, px in the window. Grouping twice by the voxel is one shuffle.
    """
    logit = bump_logit(F.col("pz"), window[0], exponent) + bump_logit(F.col("py"), window[1], exponent) + bump_logit(F.col("px"), window[2], exponent)
    per_voxel = Window.partitionBy(*by_volume(placed), "z", "y", "x")
    weighted = placed.withColumn("l", logit).withColumn("w", F.exp(F.col("l") - F.max("l").over(per_voxel)))
    return blended(weighted, "w")


def valid_range(shape: tuple[int, int, int], patch: tuple[int, int, int], offset: tuple[int, int, int] = (0, 0, 0)) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Places at which a centred patch lies inside (first, one after the last)."""
    lo = tuple(o + p // 2 for o, p in zip(offset, patch))
    hi = tuple(o + s - (p - p // 2) + 1 for o, s, p in zip(offset, shape, patch))
    return lo, hi


def common_range(ranges: list) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Places valid in all of several tensors."""
    return tuple(max(r[0][k] for r in ranges) for k in range(3)), tuple(min(r[1][k] for r in ranges) for k in range(3))


def centred_patch(voxels: DataFrame, at: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """The voxels of a patch centred at a place, re-origined."""
    lo = [a - s // 2 for a, s in zip(at, size)]
    out = voxels
    for axis, a, s in zip("zyx", lo, size):
        out = out.where(F.col(axis).between(a, a + s - 1)).withColumn(axis, F.col(axis) - a)
    return out


#: How a patch's values meet those that are there.
COMBINE = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.max_by(c, "_order")}


def set_patch(voxels: DataFrame, patch: DataFrame, op: str = "last") -> DataFrame:
    """A patch (z, y, x, v in the volume's places) put into a volume."""
    names = [*by_volume(voxels), "z", "y", "x", "v"]
    both = voxels.select(*names, F.lit(0).alias("_order")).unionByName(patch.select(*names, F.lit(1).alias("_order")))
    return both.groupBy(*names[:-1]).agg(COMBINE[op]("v").alias("v"))
