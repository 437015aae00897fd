"""Points, vectors and boxes as column expressions. Columns are named z, y, x; axes tuples of users are x, y, z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


# F8: vectors are structs (z, y, x)
def vec(z, y, x) -> Column:
    return F.struct(*((c if isinstance(c, Column) else F.lit(float(c))).alias(n) for c, n in zip((z, y, x), AXES)))


def _each(f, *vectors: Column) -> Column:
    return F.struct(*(f(*(v[a] for v in vectors)).alias(a) for a in AXES))


def add(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p + q, a, b)


def sub(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p - q, a, b)


def mul(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p * q, a, b)


def scale(a: Column, k) -> Column:
    return _each(lambda p: p * k, a)


def div(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p / F.nullif(q, F.lit(0)), a, b)


def floor_div(a: Column, b: Column) -> Column:
    return _each(lambda p, q: F.floor(p / F.nullif(q, F.lit(0))), a, b)


def mod(a: Column, b: Column) -> Column:
    """The remainder has the divisor's sign."""
    return _each(lambda p, q: p - q * F.floor(p / F.nullif(q, F.lit(0))), a, b)


def power(a: Column, k) -> Column:
    return _each(lambda p: F.pow(p, F.lit(k)), a)


def minimum(a: Column, b: Column) -> Column:
    return _each(F.least, a, b)


def maximum(a: Column, b: Column) -> Column:
    return _each(F.greatest, a, b)


def dot(a: Column, b: Column) -> Column:
    return sum((a[n] * b[n] for n in AXES[1:]), a["z"] * b["z"])


def cross(a: Column, b: Column) -> Column:
    """In the order of (z, y, x)."""
    return vec(a["y"] * b["x"] - a["x"] * b["y"], a["x"] * b["z"] - a["z"] * b["x"], a["z"] * b["y"] - a["y"] * b["z"])


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def normalised(a: Column) -> Column:
    return scale(a, 1 / F.nullif(length(a), F.lit(0.0)))


def projection(a: Column, onto: Column) -> Column:
    return scale(onto, dot(a, onto) / F.nullif(dot(onto, onto), F.lit(0.0)))


def between(a: Column, b: Column, share) -> Column:
    """Interpolation: a at 0, b at 1."""
    return add(a, scale(sub(b, a), share))


# boxes are structs (lo, hi) of vectors, half-open
def box(lo: Column, hi: Column) -> Column:
    return F.struct(minimum(lo, hi).alias("lo"), maximum(lo, hi).alias("hi"))


def centred_box(centre: Column, size: Column) -> Column:
    """From c - s // 2, so that the box has exactly that size."""
    lo = _each(lambda c, s: c - F.floor(s / 2), centre, size)
    return F.struct(lo.alias("lo"), add(lo, size).alias("hi"))


def size_of(b: Column) -> Column:
    return sub(b["hi"], b["lo"])


def volume_of(b: Column) -> Column:
    s = size_of(b)
    return s["z"] * s["y"] * s["x"]


def contains(b: Column, p: Column) -> Column:
    out = F.lit(True)
    for n in AXES:
        out &= (p[n] >= b["lo"][n]) & (p[n] < b["hi"][n])
    return out


def overlaps(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for n in AXES:
        out &= (a["lo"][n] < b["hi"][n]) & (b["lo"][n] < a["hi"][n])
    return out


def intersect(a: Column, b: Column) -> Column:
    """U4: null where they do not overlap."""
    return F.when(overlaps(a, b), F.struct(maximum(a["lo"], b["lo"]).alias("lo"), minimum(a["hi"], b["hi"]).alias("hi")))


def merge(a: Column, b: Column) -> Column:
    return F.struct(minimum(a["lo"], b["lo"]).alias("lo"), maximum(a["hi"], b["hi"]).alias("hi"))


def translate(b: Column, by: Column) -> Column:
    return F.struct(add(b["lo"], by).alias("lo"), add(b["hi"], by).alias("hi"))


def expand(b: Column, by: Column) -> Column:
    return F.struct(sub(b["lo"], by).alias("lo"), add(b["hi"], by).alias("hi"))


# F4 to F7, F10
def resample_points(points: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """coordinates times new / old on each axis."""
    return points.withColumns({a: F.col(a) * (n / o) for a, o, n in zip(AXES, old, new)})


def axes_of(spec: tuple[str, str, str]) -> list[tuple[int, bool]]:
    """For each new axis (z, y, x) the old axis it comes from (0 to 2 for z, y, x) and whether it is reversed.

    The spec names x, y, z; "-0" is the first axis reversed.
    """
    return [(abs(2 - abs(int(s))), s.startswith("-")) for s in reversed(spec)]


def reorient(rows: DataFrame, dims: tuple[int, int, int], spec: tuple[str, str, str]) -> DataFrame:
    """axes are reversed (dim - (c + 1)) and then permuted; for points and voxels alike."""
    sources = [(f"_{AXES[k]}", dims[k] - (F.col(AXES[k]) + 1) if back else F.col(AXES[k])) for k, back in axes_of(spec)]
    return rows.withColumns({f"_new_{a}": c for a, (_, c) in zip(AXES, sources)}).drop(*AXES).withColumnsRenamed({f"_new_{a}": a for a in AXES})


def reoriented_dims(dims: tuple[int, int, int], spec: tuple[str, str, str]) -> tuple[int, int, int]:
    """by the same permutation as reorient."""
    return tuple(dims[k] for k, _ in axes_of(spec))


def affine(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A 4 x 4 homogeneous matrix applied to (z, y, x, 1)."""
    return points.withColumns({a: sum((F.lit(float(matrix[r][c])) * F.col(AXES[c]) for c in range(3)), F.lit(float(matrix[r][3]))) for r, a in enumerate(AXES)})


def chained(points: DataFrame, transforms: list[list[list[float]]]) -> DataFrame:
    """Transforms one after the other, as one matrix."""
    whole = [[float(i == j) for j in range(4)] for i in range(4)]
    for m in transforms:
        whole = [[sum(m[i][k] * whole[k][j] for k in range(4)) for j in range(4)] for i in range(4)]
    return affine(points, whole)


def affine_jacobian(matrix: list[list[float]]) -> float:
    """The same everywhere."""
    (a, b, c), (d, e, f), (g, h, i) = (row[:3] for row in matrix[:3])
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
