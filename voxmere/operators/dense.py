"""Voxel kernels on dense blocks with halos.

Space is cut into blocks; a voxel goes to the block it is in and, if it is within a kernel's radius of their faces, to
the blocks next to it. A block is about eight radii long on each axis, so less than twice the voxels are moved
whatever the radius, where sending each value to all places around it would move (2 r + 1)**3 times as many. Each
block is one task's small array (at most CELLS places), on which box-shaped kernels work axis by axis.

Volumes have at most one voxel at a place; of several the largest counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most places of a block, halo included, and so many that a block has as a rule: a group costs as much as some 10 000 places.
CELLS, USUAL = 1 << 22, 1 << 16
Radius = tuple[int, int, int]
#: From values (-inf where nothing is) over a block and its halo to values over the block, NaN where there is none.
Kernel = Callable[[np.ndarray], np.ndarray]


def edges(radius: Radius) -> Radius:
    """A block's lengths: eight radii, at least 16, more where it would have less than USUAL places and less where it would have more than CELLS."""
    out = [max(16, 8 * r) for r in radius]
    while np.prod([e + 2 * r for e, r in zip(out, radius)]) < USUAL:
        out[out.index(min(out))] *= 2
    while np.prod([e + 2 * r for e, r in zip(out, radius)]) > CELLS and any(e > max(16, r) for e, r in zip(out, radius)):
        k = max(range(3), key=lambda i: out[i] - max(16, radius[i]))
        out[k] = max(16, radius[k], out[k] // 2)
    return tuple(out)


def dealt(voxels: DataFrame, radius: Radius, by: list[str]) -> DataFrame:
    """Voxels with the blocks (gz, gy, gx) whose halo holds them."""
    out = voxels.select(*by, "z", "y", "x", "v")
    for c, e, r in zip("zyx", edges(radius), radius):
        out = out.withColumn(f"g{c}", F.explode(F.sequence(F.floor((F.col(c) - r) / e).cast("int"), F.floor((F.col(c) + r) / e).cast("int"))))
    return out


def by_block(voxels: DataFrame, radius: Radius, kernel: Kernel, placed: bool = False) -> DataFrame:
    """The kernel's voxels, from every block that it gives any in; with `placed` it also gets the place of the block's first voxel."""
    by = [c for c in ("volume_id",) if c in voxels.columns]
    edge = edges(radius)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        start = [int(first[f"g{c}"]) * e for c, e in zip("zyx", edge)]
        at = tuple(pdf[c].to_numpy() - s + r for c, s, r in zip("zyx", start, radius))
        block = np.full([e + 2 * r for e, r in zip(edge, radius)], -np.inf)
        np.maximum.at(block, at, pdf["v"].to_numpy())
        out = kernel(block, start) if placed else kernel(block)
        z, y, x = np.nonzero(~np.isnan(out))
        place = {c: (k + s).astype(np.int32) for c, k, s in zip("zyx", (z, y, x), start)}
        return pd.DataFrame({**{c: np.full(len(z), first[c], object) for c in by}, **place, "v": out[z, y, x]})

    keys = [*by, "gz", "gy", "gx"]
    return dealt(voxels, radius, by).groupBy(*keys).applyInPandas(work, ", ".join([*(f"{c} string" for c in by), "z int, y int, x int, v double"]))


def largest_around(points: DataFrame, voxels: DataFrame, radius: Radius, name: str) -> DataFrame:
    """The points (volume_id, z, y, x and more) with `name`, the largest value in the box around each; null where it has none.

    A point goes to the block it is in, and meets that block's voxels as an array: no pair of a point and a voxel is
    formed, however many voxels a box holds.
    """
    by = [c for c in ("volume_id",) if c in voxels.columns]
    edge = edges(radius)
    keys = [*by, "gz", "gy", "gx"]
    kept = points.columns
    asked = points.withColumns({f"g{c}": F.floor(F.col(c) / e).cast("int") for c, e in zip("zyx", edge)})

    def read(asked: pa.Table, held: pa.Table) -> pa.Table:
        block = np.full([e + 2 * r for e, r in zip(edge, radius)], -np.inf)
        if len(asked) and len(held):
            start = [held[f"g{c}"][0].as_py() * e for c, e in zip("zyx", edge)]
            np.maximum.at(block, tuple(held[c].to_numpy() - s + r for c, s, r in zip("zyx", start, radius)), held["v"].to_numpy())
            block = along(block, radius, np.maximum)
            found = block[tuple(asked[c].to_numpy() - s for c, s in zip("zyx", start))]
        else:
            found = np.full(len(asked), -np.inf)
        return asked.select(kept).append_column(name, pa.array(found, mask=np.isneginf(found)))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema), f"`{name}` double"])
    return asked.groupBy(*keys).cogroup(dealt(voxels.where("v is not null"), radius, by).groupBy(*keys)).applyInArrow(read, schema)


def over_otsu(points: DataFrame, voxels: DataFrame, radius: Radius, bins: int, lo: float, hi: float, factor: float) -> DataFrame:
    """(by, z, y, x) of the voxels that reach Otsu's threshold of the box around a point over `factor`; once for every block that finds them.

    Values beyond lo to hi have no bin. A point meets its block's voxels as an array, as in largest_around.
    """
    by = [c for c in ("volume_id",) if c in voxels.columns]
    edge = edges(radius)
    keys = [*by, "gz", "gy", "gx"]
    asked = points.select(*by, *(F.col(c).cast("double").alias(c) for c in "zyx")).where("z is not null and y is not null and x is not null")
    asked = asked.withColumns({f"g{c}": F.floor(F.ceil(c) / e).cast("int") for c, e in zip("zyx", edge)})
    schema = pa.schema([*((c, pa.string()) for c in by), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32())])

    def read(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (len(asked) and len(held)):
            return schema.empty_table()
        start = [held[f"g{c}"][0].as_py() * e for c, e in zip("zyx", edge)]
        block = np.full([e + 2 * r for e, r in zip(edge, radius)], -np.inf)
        np.maximum.at(block, tuple(held[c].to_numpy() - s + r for c, s, r in zip("zyx", start, radius)), held["v"].to_numpy())
        found = np.zeros(block.shape, dtype=bool)
        steps = [k.ravel() for k in np.indices([2 * r + 1 for r in radius])]
        middle = [asked[c].to_numpy() - s for c, s in zip("zyx", start)]
        most = max(1, (1 << 20) // len(steps[0]))
        for i in range(0, len(asked), most):
            c = [m[i : i + most, None] for m in middle]
            at = tuple(np.ceil(m).astype(np.int64) + k for m, k in zip(c, steps))
            v = block[at]
            for m, k, r in zip(c, at, radius):  # of a centre between places
                v[k > m + 2 * r] = -np.inf
            with np.errstate(divide="ignore", invalid="ignore"):
                fits = (v >= lo) & (v <= hi)
                bin_ = np.minimum(bins - 1, np.floor((v[fits] - lo) / (hi - lo) * bins)).astype(np.int64)
                n0 = np.bincount(np.nonzero(fits)[0] * bins + bin_, minlength=len(v) * bins).reshape(len(v), bins)
                n0, s0 = np.cumsum(n0, axis=1), np.cumsum(n0 * np.arange(bins), axis=1)
                n, s = n0[:, -1:], s0[:, -1:]
                apart = s0 / n0 - (s - s0) / (n - n0)
                score = np.where((n0 > 0) & (n0 < n), n0 * (n - n0) * (apart * apart), -np.inf)
            best = score.argmax(axis=1)
            limit = np.where(np.isneginf(score.max(axis=1)), np.nan, (lo + (best + 1) * ((hi - lo) / bins)) / factor)[:, None]
            reach = ~np.isneginf(v) & ((v >= limit) | (np.isnan(v) & ~np.isnan(limit)))  # NaN is the largest, as in Spark
            found[tuple(k[reach] for k in at)] = True
        places = np.nonzero(found)
        names = [pa.array([held[c][0].as_py()] * len(places[0]), pa.string()) for c in by]
        return pa.table([*names, *(pa.array((k + s - r).astype(np.int32)) for k, s, r in zip(places, start, radius))], schema=schema)

    return asked.groupBy(*keys).cogroup(dealt(voxels.where("v is not null"), radius, by).groupBy(*keys)).applyInArrow(read, ", ".join([*(f"{c} string" for c in by), "z int, y int, x int"]))


def along(block: np.ndarray, radius: Radius, join: np.ufunc, weights: tuple = (None, None, None)) -> np.ndarray:
    """The values of each box joined, one axis after the other; the result is as large as the block without its halo."""
    for axis, (r, w) in enumerate(zip(radius, weights)):
        n = block.shape[axis] - 2 * r
        out = None
        for k in range(2 * r + 1):
            part = block[(slice(None),) * axis + (slice(k, k + n),)]
            part = part if w is None else part * w[k]
            out = part.copy() if out is None else join(out, part, out=out)
        block = out
    return block


def core(block: np.ndarray, radius: Radius) -> np.ndarray:
    return block[tuple(slice(r, n - r) for r, n in zip(radius, block.shape))]


def largest(radius: Radius) -> Kernel:
    """The largest value of each box that has any."""

    def kernel(block: np.ndarray) -> np.ndarray:
        out = along(block, radius, np.maximum)
        return np.where(np.isneginf(out), np.nan, out)

    return kernel


def least_of_full(radius: Radius) -> Kernel:
    """The least value of each box without a gap."""

    def kernel(block: np.ndarray) -> np.ndarray:
        out = along(block, radius, np.minimum)
        return np.where(np.isneginf(out), np.nan, out)

    return kernel


def total(radius: Radius, weights: tuple = (None, None, None), scale: float = 1.0, everywhere: bool = False) -> Kernel:
    """The weighted sum of each box, gaps as 0, times `scale`: at the voxels that are there, or wherever a box has any."""

    def kernel(block: np.ndarray) -> np.ndarray:
        there = ~np.isneginf(block)
        out = along(np.where(there, block, 0.0), radius, np.add, weights) * scale
        return np.where(along(there, radius, np.logical_or) if everywhere else core(there, radius), out, np.nan)

    return kernel


def median(radius: Radius, rows: int = 1 << 14, gaps: float | None = None) -> Kernel:
    """The median of what is in each box, at the voxels that are there; with `gaps` of the whole box, wherever half of it or more is there."""
    n = int(np.prod([2 * r + 1 for r in radius]))

    def kernel(block: np.ndarray) -> np.ndarray:
        out = np.full(core(block, radius).shape, np.nan)
        there = ~np.isneginf(block)
        at = np.nonzero(core(there, radius) if gaps is None else 2 * along(there.astype(np.int32), radius, np.add) >= n)
        boxes = np.lib.stride_tricks.sliding_window_view(np.where(there, block, np.nan if gaps is None else gaps), [2 * r + 1 for r in radius])
        step = max(1, rows * 27 // n)
        for i in range(0, len(at[0]), step):
            some = tuple(a[i : i + step] for a in at)
            out[some] = np.nanmedian(boxes[some].reshape(len(some[0]), -1), axis=1)
        return out

    return kernel


def element(parts: list[tuple[int, int, int, float]], radius: Radius) -> Kernel:
    """The largest of an element's values (dz, dy, dx, v) put at each place that is there."""

    def kernel(block: np.ndarray) -> np.ndarray:
        there = ~np.isneginf(block)
        out = np.full(core(block, radius).shape, -np.inf)
        for dz, dy, dx, v in parts:
            part = there[tuple(slice(r - d, r - d + n) for r, d, n in zip(radius, (dz, dy, dx), out.shape))]
            np.maximum(out, np.where(part, v, -np.inf), out=out)
        return np.where(np.isneginf(out), np.nan, out)

    return kernel
