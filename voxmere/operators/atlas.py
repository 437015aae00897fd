"""Points and voxels against an annotated volume: lookup, counts per structure, masks and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def truncated(points: DataFrame, dims: tuple[int, int, int] | None = None, wrap_negative: bool = False) -> DataFrame:
    """points with zi, yi, xi: the coordinates cut towards zero. With wrap_negative (and dims) -1 is the last plane, and so on."""
    out = points
    for axis, dim in zip(AXES, dims or (None,) * 3):
        cut = F.col(axis).cast("int")
        out = out.withColumn(f"{axis}i", F.when(cut < 0, cut + dim).otherwise(cut) if wrap_negative and dim else cut)
    return out


def lookup(points: DataFrame, annotation: DataFrame, dims: tuple[int, int, int] | None = None, wrap_negative: bool = False) -> DataFrame:
    """Points with the id of the structure they are in; those outside or in the background (id 0) are left out."""
    known = annotation.where("id <> 0").select(F.col("z").alias("zi"), F.col("y").alias("yi"), F.col("x").alias("xi"), "id")
    return truncated(points, dims, wrap_negative).join(known, ["zi", "yi", "xi"]).drop("zi", "yi", "xi")


def inside(dims: tuple[int, int, int]) -> Column:
    """No coordinate reaches its dimension (negative ones pass)."""
    return (F.col("z") < dims[0]) & (F.col("y") < dims[1]) & (F.col("x") < dims[2])


def missed(points: DataFrame, dims: tuple[int, int, int], *by: str) -> DataFrame:
    """P10: how many points' truncated places are outside the volume."""
    t = truncated(points)
    out = ~(F.col("zi").between(0, dims[0] - 1) & F.col("yi").between(0, dims[1] - 1) & F.col("xi").between(0, dims[2] - 1))
    return t.groupBy(*by).agg(F.count(F.when(out, 1)).alias("n_outside"), F.count(F.lit(1)).alias("n_points"))


def region_counts(located: DataFrame, structure: DataFrame, *by: str) -> DataFrame:
    """Number of points of every structure, 0 where none is; ids without a structure are lost.

    With `by` columns (as brain) each of their values gets all structures.
    """
    counts = located.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("cell_count"))
    rows = structure.crossJoin(located.select(*by).distinct()) if by else structure
    return rows.join(counts, [*by, "id"], "left").fillna(0, ["cell_count"])


def named(ids: DataFrame, structure: DataFrame) -> DataFrame:
    """Ids with their names; 0 and unknown ids are dropped."""
    return ids.where("id <> 0").join(structure.select("id", "name"), "id")


def location_counts(points: DataFrame, annotation: DataFrame, structure: DataFrame) -> DataFrame:
    """Names and counts of the structures that the points are in."""
    return named(lookup(points, annotation).groupBy("id").agg(F.count(F.lit(1)).alias("n")), structure)


def per_voxel(points: DataFrame) -> DataFrame:
    """A3: points in each integer voxel."""
    return truncated(points).groupBy(F.col("zi").alias("z"), F.col("yi").alias("y"), F.col("xi").alias("x")).agg(F.count(F.lit(1)).alias("n"))


def voxel_counts(annotation: DataFrame) -> DataFrame:
    """Voxels of each structure."""
    return annotation.where("id <> 0").groupBy("id").agg(F.count(F.lit(1)).alias("voxels_in_structure"))


def isolate(annotation: DataFrame, ids: DataFrame | list[int], value: int = 255) -> DataFrame:
    """The voxels of the given structures, set to one value."""
    hit = annotation.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else annotation.where(F.col("id").isin(ids))
    return hit.select(*AXES, F.lit(value).alias("v"))


def density(annotation: DataFrame, counts: DataFrame, count: str = "cell_count") -> DataFrame:
    """Every voxel painted with its structure's count, scaled from 0 (least) to 255 (most)."""
    bounds = counts.agg(F.min(count).alias("lo"), F.max(count).alias("hi"))
    scaled = counts.crossJoin(F.broadcast(bounds)).select("id", F.when(F.col("hi") > F.col("lo"), (F.col(count) - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("v"))
    return annotation.join(scaled, "id").select(*AXES, "v")


def slice_of(text: str) -> tuple[int | None, int | None]:
    """Bounds of `all`, `:` or `a:b`; never evaluated as code."""
    if text in ("all", ":", ""):
        return None, None
    lo, _, hi = text.partition(":")
    return (int(lo) if lo else None), (int(hi) if hi else None)


def _within(axis: str, text: str) -> Column:
    lo, hi = slice_of(text)
    out = F.lit(True)
    if lo is not None:
        out &= F.col(axis) >= lo
    if hi is not None:
        out &= F.col(axis) < hi
    return out


def mask(voxels: DataFrame, z: str = "all", y: str = "all", x: str = "all") -> DataFrame:
    """What is outside the ranges becomes background, which a sparse volume does not hold."""
    return voxels.where(_within("z", z) & _within("y", y) & _within("x", x))


def crop(voxels: DataFrame, z: str = "all", y: str = "all", x: str = "all") -> DataFrame:
    """Like mask, and the first kept place becomes 0."""
    out = mask(voxels, z, y, x)
    for axis, text in zip(AXES, (z, y, x)):
        out = out.withColumn(axis, F.col(axis) - (slice_of(text)[0] or 0))
    return out


def replace_where(voxels: DataFrame, equals: float, new: float, z: str = "all", y: str = "all", x: str = "all") -> DataFrame:
    """Inside the ranges, values that equal one number become another."""
    return voxels.withColumn("v", F.when(_within("z", z) & _within("y", y) & _within("x", x) & (F.col("v") == equals), F.lit(new)).otherwise(F.col("v")))
