"""Augmentations of training samples as maps of coordinates and values (sparse voxels z, y, x, v; dims are of the sample)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmere.functions.maths import grayscale
from voxmere.operators.edges import by_section
from voxmere.operators.raster import by_volume


def flip(voxels: DataFrame, dims: tuple[int, int, int], axes: str) -> DataFrame:
    """M3: mirrored along the named axes."""
    return voxels.withColumns({a: d - 1 - F.col(a) for a, d in zip("zyx", dims) if a in axes})


def transpose(voxels: DataFrame) -> DataFrame:
    """M3: y and x change places."""
    return voxels.withColumns({"y": F.col("x"), "x": F.col("y")})


def gray(voxels: DataFrame, contrast: float, brightness: float, log_gamma: float) -> DataFrame:
    """M4, 3-D."""
    return voxels.withColumn("v", grayscale(F.col("v"), contrast, brightness, log_gamma))


def gray_sections(voxels: DataFrame, seed: int, contrast: float = 0.3, brightness: float = 0.3) -> DataFrame:
    """M4, 2-D: every section draws its own factors; they follow from the seed and z, so a rerun draws the same."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("z")), F.lit(1 << 20)) / float(1 << 20)
    return voxels.withColumn("v", grayscale(F.col("v"), 1 + (draw(1) - 0.5) * contrast, (draw(2) - 0.5) * brightness, draw(3) * 2 - 1))


def fill_sections(voxels: DataFrame, sections: list[int], value: float, quadrant: Column | None = None) -> DataFrame:
    """M5: sections, or one part of them, become one value (0 takes them out)."""
    hit = F.col("z").isin(sections) & (quadrant if quadrant is not None else F.lit(True))
    return voxels.where(~hit) if value == 0 else voxels.withColumn("v", F.when(hit, F.lit(value)).otherwise(F.col("v")))


def misalign(voxels: DataFrame, dims: tuple[int, int, int], z: int, dy: int, dx: int, slip: bool = False) -> DataFrame:
    """M6: sections from z on (only z itself with slip) are shifted; what leaves the sample is cut."""
    hit = F.col("z") == z if slip else F.col("z") >= z
    out = voxels.withColumns({"y": F.col("y") + F.when(hit, dy).otherwise(0), "x": F.col("x") + F.when(hit, dx).otherwise(0)})
    return out.where(F.col("y").between(0, dims[1] - 1) & F.col("x").between(0, dims[2] - 1))


def lose_sections(voxels: DataFrame, sections: list[int]) -> DataFrame:
    """M7: sections go and the later ones close up."""
    below = sum((F.when(F.col("z") > s, 1).otherwise(0) for s in sections), F.lit(0))
    return voxels.where(~F.col("z").isin(sections)).withColumn("z", F.col("z") - below)


def occlude(voxels: DataFrame, boxes: list[tuple[tuple[int, int, int], tuple[int, int, int]]], value: float = 0.0) -> DataFrame:
    """M8, M9: half-open boxes (from, to) become one value; 0 takes them out. A track is a long box."""
    inside = F.lit(False)
    for lo, hi in boxes:
        inside |= F.col("z").between(lo[0], hi[0] - 1) & F.col("y").between(lo[1], hi[1] - 1) & F.col("x").between(lo[2], hi[2] - 1)
    return voxels.where(~inside) if value == 0 else voxels.withColumn("v", F.when(inside, F.lit(value)).otherwise(F.col("v")))


def sampled_boxes(dims: tuple[int, int, int], size: tuple[int, int, int], density: float, seed: int) -> list:
    """M8: random boxes until their volume is a share of the sample's."""
    rng = np.random.default_rng(seed)
    n = int(density * dims[0] * dims[1] * dims[2] / (size[0] * size[1] * size[2]))
    lo = [tuple(int(rng.integers(0, max(1, d - s + 1))) for d, s in zip(dims, size)) for _ in range(n)]
    return [(a, tuple(x + s for x, s in zip(a, size))) for a in lo]


def linear_map(rotation: float = 0.0, shear: tuple[float, float] = (0.0, 0.0), stretch: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[list[float]]:
    """(z, y, x) stretched, then sheared within sections (y by x, x by y), then turned by `rotation` degrees within sections."""
    c, s = float(np.cos(np.radians(rotation))), float(np.sin(np.radians(rotation)))
    turn = np.array([[1, 0, 0], [0, c, -s], [0, s, c]])
    slant = np.array([[1, 0, 0], [0, 1, shear[0]], [0, shear[1], 1]])
    return (turn @ slant @ np.diag(stretch)).tolist()


def _pulled(voxels: DataFrame, dims: tuple[int, int, int], forward: list, back, extent: list) -> DataFrame:
    """New places that look up an old voxel: each voxel lists the places near where it goes and keeps those that come back to it, so the cost is in proportion to the voxels and not to the volume."""
    by = by_volume(voxels)
    out = voxels.select(*by, *(F.col(c).alias(f"o{c}") for c in "zyx"), "v")
    for c, to, e, d in zip("zyx", forward, extent, dims):
        lo, hi = F.greatest(F.lit(0), F.ceil(to - e - 1e-6).cast("int")), F.least(F.lit(d - 1), F.floor(to + e + 1e-6).cast("int"))
        out = out.where(lo <= hi).withColumn(c, F.explode(F.sequence(lo, hi)))
    same = [F.round(b).cast("int") == F.col(f"o{c}") for c, b in zip("zyx", back)]
    return out.where(same[0] & same[1] & same[2]).select(*by, "z", "y", "x", "v")


def warp(voxels: DataFrame, dims: tuple[int, int, int], matrix: list[list[float]]) -> DataFrame:
    """Nearest-neighbour affine map about the sample's centre; every new place looks up the old one it comes from."""
    inverse = np.linalg.inv(np.array(matrix, float)).tolist()
    middle = [(d - 1) / 2 for d in dims]
    at = lambda m, names: [sum((F.lit(float(m[r][c])) * (F.col(a) - middle[c]) for c, a in enumerate(names)), F.lit(middle[r])) for r in range(3)]
    extent = [F.lit(0.5 * sum(abs(v) for v in row)) for row in matrix]
    return _pulled(voxels, dims, at(matrix, ("oz", "oy", "ox")), at(inverse, "zyx"), extent)


def twist(voxels: DataFrame, dims: tuple[int, int, int], degrees: float) -> DataFrame:
    """Sections turned about the sample's axis, the first by -degrees / 2 and the last by degrees / 2."""
    middle = [(d - 1) / 2 for d in dims]
    angle = lambda z: F.radians(F.lit(float(degrees)) * ((F.col(z) - middle[0]) / max(1, dims[0] - 1)))
    turned = lambda a, y, x: (F.cos(a) * (F.col(y) - middle[1]) - F.sin(a) * (F.col(x) - middle[2]) + middle[1], F.sin(a) * (F.col(y) - middle[1]) + F.cos(a) * (F.col(x) - middle[2]) + middle[2])
    reach = 0.5 * (F.abs(F.cos(angle("oz"))) + F.abs(F.sin(angle("oz"))))
    return _pulled(voxels, dims, [F.col("oz"), *turned(angle("oz"), "oy", "ox")], [F.col("z"), *turned(-angle("oz"), "y", "x")], [F.lit(0.0), reach, reach])


def blur_sections(voxels: DataFrame, dims: tuple[int, int, int], sections: list[int], sigma: float) -> DataFrame:
    """M5: Gaussian blur within sections; each is one image in one task."""

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros(dims[1:])
        image[pdf["y"], pdf["x"]] = pdf["v"]
        r = int(4 * sigma + 0.5)
        kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
        kernel /= kernel.sum()
        for axis in (0, 1):
            image = np.apply_along_axis(lambda m: np.convolve(m, kernel)[r : r + len(m)], axis, image)  # also where the kernel is longer
        y, x = np.nonzero(image)
        return pd.DataFrame({"z": int(pdf["z"].iloc[0]), "y": y, "x": x, "v": image[y, x]})

    blurred = by_section(voxels.where(F.col("z").isin(sections)), blur)
    return voxels.where(~F.col("z").isin(sections)).select(*by_volume(voxels), "z", "y", "x", "v").unionByName(blurred)


def with_mask(samples: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """P20: the samples whose mask has any voxel."""
    return samples.join(masks.where("v <> 0").select(key).distinct(), key, "left_semi")


def random_points(spark: SparkSession, n: int, dims: tuple[int, int, int], seed: int) -> DataFrame:
    """(idx, z, y, x) of n points in a volume; they follow from the seed and the number, so a rerun draws the same."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    return spark.range(n).select(F.col("id").alias("idx"), *(F.floor(u(k) * d).cast("int").alias(c) for k, (c, d) in enumerate(zip("zyx", dims))))


def composed(voxels: DataFrame, *steps) -> DataFrame:
    """M2: augmentations one after the other; each takes and returns a DataFrame."""
    for step in steps:
        voxels = step(voxels)
    return voxels


def split(samples: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Samples with the part they belong to, by a hash of their key, so that a sample never changes part."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    part = F.lit(None).cast("string")
    for name, share in reversed(shares.items()):
        part = F.when(u < sum(list(shares.values())[: list(shares).index(name) + 1]), name).otherwise(part)
    return samples.withColumn("part", F.coalesce(part, F.lit(list(shares)[-1])))


def sample_places(datasets: DataFrame, n: int, seed: int) -> DataFrame:
    """M1: n random centres; datasets (dataset, weight, lo and hi arrays of valid places) are drawn in proportion to their weights."""
    spark = datasets.sparkSession
    rows = datasets.select("dataset", "weight", "lo", "hi").orderBy("dataset").collect()  # one row for each training volume
    weights = np.cumsum([r["weight"] for r in rows]) / sum(r["weight"] for r in rows)
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    index = sum((F.when(u(0) >= float(w), 1).otherwise(0) for w in weights[:-1]), F.lit(0))
    known = spark.createDataFrame([(i, r["dataset"], list(r["lo"]), list(r["hi"])) for i, r in enumerate(rows)], "k int, dataset string, lo array<int>, hi array<int>")
    drawn = spark.range(n).withColumn("k", index).join(F.broadcast(known), "k")
    return drawn.select("id", "dataset", *((F.col("lo")[i] + F.floor(u(i + 1) * (F.col("hi")[i] - F.col("lo")[i]))).cast("int").alias(a) for i, a in enumerate("zyx")))


def mask_places(masks: DataFrame, ranges: DataFrame, n: int, seed: int) -> DataFrame:
    """M1: up to n places of each dataset, drawn evenly and without repeats among its mask's voxels that are in its valid range.

    masks: (dataset, z, y, x, v), voxels with v <> 0 count; ranges: (dataset, lo, hi) arrays of valid places, hi not
    included. Each valid voxel has a priority of its own, a digest of the seed, its dataset and place, and the n
    first are drawn; invalid places take no part, so none has to be drawn again. Tasks keep their n first before
    anything is moved.
    """
    valid = masks.where("v <> 0").join(ranges, "dataset")
    for k, c in enumerate("zyx"):
        valid = valid.where((F.col(c) >= F.col("lo")[k]) & (F.col(c) < F.col("hi")[k]))
    keyed = valid.select("dataset", "z", "y", "x", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("dataset").cast("string"), *(F.col(c).cast("string") for c in "zyx")).cast("binary")).alias("priority")).distinct()
    order = Window.partitionBy("dataset").orderBy("priority")
    return keyed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("dataset", "k", "z", "y", "x")
