"""Voxel kernels as joins and aggregates: projections, neighbourhoods, stitching, thresholds, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmere.operators import dense
from voxmere.operators.graph import written
from voxmere.operators.quantiles import quantiles, with_quantiles


def by_volume(voxels: DataFrame) -> list[str]:
    """The column that keeps volumes apart, where there is one."""
    return [c for c in ("volume_id",) if c in voxels.columns]


def statistics(voxels: DataFrame, *by: str) -> DataFrame:
    """A10."""
    moments = voxels.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    places = with_quantiles(voxels, "v", {"median": 0.5, "p95": 0.95}, *by)
    return moments.join(places, list(by), "left") if by else moments.join(places, F.lit(True), "left")


def project(voxels: DataFrame, axis: str = "z") -> DataFrame:
    """Maximum along an axis."""
    return voxels.groupBy(*by_volume(voxels), *(c for c in "zyx" if c != axis)).agg(F.max("v").alias("v"))


def scaled(voxels: DataFrame, top: float = 1.0, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """values from 0 (least) to `top` (most); with percentiles lo and hi (0 to 1) clipped to these first."""
    by = by_volume(voxels)
    ends = voxels.groupBy(*by).agg(F.min("v").alias("a"), F.max("v").alias("b")) if lo is None else with_quantiles(voxels, "v", {"a": lo, "b": hi}, *by)
    v = F.least(F.col("b"), F.greatest(F.col("a"), F.col("v")))
    both = voxels.join(ends, by) if by else voxels.crossJoin(F.broadcast(ends))
    return both.withColumn("v", F.when(F.col("b") > F.col("a"), (v - F.col("a")) * top / (F.col("b") - F.col("a"))).otherwise(0.0)).drop("a", "b")


def box_filter(voxels: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    """Mean over the whole box at each voxel, background as 0."""
    n = float((2 * radius[0] + 1) * (2 * radius[1] + 1) * (2 * radius[2] + 1))
    return dense.by_block(voxels, radius, dense.total(radius, scale=1 / n))


def median_filter(voxels: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    """At each voxel the median of the values that are there."""
    return dense.by_block(voxels, radius, dense.median(radius))


def within(voxels: DataFrame, dims: tuple[int, int, int] | None) -> DataFrame:
    """The voxels inside a volume of these dimensions; all where none are given."""
    for axis, d in zip("zyx", dims or ()):
        voxels = voxels.where(F.col(axis).between(0, d - 1))
    return voxels


def gaussian_filter(voxels: DataFrame, sigma: tuple[float, float, float], reach: float = 4.0, dims: tuple[int, int, int] | None = None) -> DataFrame:
    """Gaussian blur, one axis after the other, background as 0; places inside `dims` that gain value are kept."""
    radius = tuple(int(reach * s + 0.5) for s in sigma)
    weights = []
    for s, r in zip(sigma, radius):
        bell = [2.718281828459045 ** (-k * k / (2 * s * s)) for k in range(-r, r + 1)] if r else [1.0]
        weights.append([w / sum(bell) for w in bell])
    return within(dense.by_block(voxels, radius, dense.total(radius, tuple(weights), everywhere=True)), dims)


def dilate(voxels: DataFrame, radius: tuple[int, int, int], dims: tuple[int, int, int] | None = None) -> DataFrame:
    """V8: each place (inside `dims`) within reach of a voxel gets the largest value there."""
    return within(dense.by_block(voxels, radius, dense.largest(radius)), dims)


def erode(voxels: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    """V8: voxels whose whole box is there, with its smallest value."""
    return dense.by_block(voxels, radius, dense.least_of_full(radius))


def opened(voxels: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    return dilate(erode(voxels, radius), radius)


def closed(voxels: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    """The dilation may reach beyond the volume here, since the erosion takes that away again."""
    return erode(dilate(voxels, radius), radius)


def stamp(points: DataFrame, element: list[tuple[int, int, int, float]], dims: tuple[int, int, int]) -> DataFrame:
    """The largest of an element's values (dz, dy, dx, v) put at each point, inside the volume."""
    radius = tuple(max(abs(e[k]) for e in element) for k in range(3))
    put = points.select(*by_volume(points), *(F.col(c).cast("int").alias(c) for c in "zyx"), F.lit(1.0).alias("v"))
    return within(dense.by_block(put, radius, dense.element(element, radius)), dims)


def stamped(points: DataFrame, element: list[tuple[int, int, int, float]], dims: tuple[int, int, int], top: float = 1.0) -> DataFrame:
    """V7: a stamped volume scaled to 0 to `top`, as the annotation's probability maps are; places that stay empty are background, so 0 is the least value."""
    put = stamp(points, element, dims)
    by = by_volume(put)
    most = put.groupBy(*by).agg(F.max("v").alias("most"))
    both = put.join(most, by) if by else put.crossJoin(F.broadcast(most))
    return both.withColumn("v", F.greatest(F.lit(0.0), F.col("v")) * top / F.nullif(F.col("most"), F.lit(0.0))).drop("most")


def ball(radius: int) -> list[tuple[int, int, int, float]]:
    """V7: an element that is 1 at its centre and fades to its rim."""
    r = range(-radius, radius + 1)
    return [(z, y, x, 1 - (z * z + y * y + x * x) ** 0.5 / (radius + 1)) for z in r for y in r for x in r if z * z + y * y + x * x <= radius * radius]


def cylinder(radius: int, height: int) -> list[tuple[int, int, int, float]]:
    """V7."""
    r = range(-radius, radius + 1)
    return [(z, y, x, 1.0) for z in range(-(height // 2), height - height // 2) for y in r for x in r if y * y + x * x <= radius * radius]


def ramp(place, n: int, steep: float = 10.0, logistic: bool = True):
    """weight of the right side at place 0 to n - 1 of an overlap."""
    t = -steep + 2 * steep * place / float(max(1, n - 1))
    return 1 / (1 + F.exp(-t)) if logistic else place / float(max(1, n - 1))


def stitch(tiles: DataFrame, width: int, overlap: int, logistic: bool = True) -> DataFrame:
    """Tiles (x_tile, z, y, x, v; x within a tile of `width`) side by side; where two overlap their weights add up to 1."""
    by = by_volume(tiles)
    last = tiles.groupBy(*by).agg(F.max("x_tile").alias("last"))
    into = F.when((F.col("x") < overlap) & (F.col("x_tile") > 0), ramp(F.col("x"), overlap, logistic=logistic)).otherwise(1.0)
    out = F.when((F.col("x") >= width - overlap) & (F.col("x_tile") < F.col("last")), 1 - ramp(F.col("x") - (width - overlap), overlap, logistic=logistic)).otherwise(1.0)
    w = (tiles.join(last, by) if by else tiles.crossJoin(F.broadcast(last))).withColumn("w", into * out)
    return w.groupBy(*by, "z", "y", (F.col("x_tile") * (width - overlap) + F.col("x")).alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def blend_sheets(left: DataFrame, right: DataFrame, xdim: int, steep: float = 10.0) -> DataFrame:
    """Two light sheets over the same voxels; the right one is shifted to the left one's median, values stay at least 0."""
    by = by_volume(left)
    ml, mr = with_quantiles(left, "v", {"ml": 0.5}, *by), with_quantiles(right, "v", {"mr": 0.5}, *by)
    both = left.select(*by, "z", "y", "x", F.col("v").alias("a")).join(right.select(*by, "z", "y", "x", F.col("v").alias("b")), [*by, "z", "y", "x"])
    both = both.join(ml, by).join(mr, by) if by else both.crossJoin(F.broadcast(ml)).crossJoin(F.broadcast(mr))
    w = ramp(F.col("x"), xdim, steep)
    return both.select(*by, "z", "y", "x", (F.col("a") * (1 - w) + F.greatest(F.lit(0.0), F.col("b") + F.col("ml") - F.col("mr")) * w).alias("v"))


def block_mean(voxels: DataFrame, factor: tuple[int, int, int]) -> DataFrame:
    """The volume shrunk by whole factors; background counts as 0."""
    n = float(factor[0] * factor[1] * factor[2])
    return voxels.groupBy(*by_volume(voxels), *(F.floor(F.col(c) / f).cast("int").alias(c) for c, f in zip("zyx", factor))).agg((F.sum("v") / n).alias("v"))


def resample(voxels: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Trilinear resizing. Every voxel adds to the new places that lie within one old step of it; these are a box that it computes."""
    by = by_volume(voxels)
    out = voxels.select(*by, "z", "y", "x", "v")
    for axis, o, n in zip("zyx", old, new):
        if o == n:
            continue
        ratio = o / n  # the new place k is at (k + 0.5) * ratio - 0.5 of the old axis, held within it
        lo = F.greatest(F.lit(0), F.ceil((F.col(axis) - 1 + 0.5) / ratio - 0.5)).cast("int")
        hi = F.least(F.lit(n - 1), F.floor((F.col(axis) + 1 + 0.5) / ratio - 0.5)).cast("int")
        lo = F.when(F.col(axis) == 0, F.lit(0)).otherwise(lo)
        hi = F.when(F.col(axis) == o - 1, F.lit(n - 1)).otherwise(hi)
        spread = out.where(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))
        at = F.least(F.lit(float(o - 1)), F.greatest(F.lit(0.0), (F.col("k") + 0.5) * ratio - 0.5))
        weighted = spread.withColumn("v", F.col("v") * F.greatest(F.lit(0.0), 1 - F.abs(at - F.col(axis)))).drop(axis).withColumnRenamed("k", axis)
        out = weighted.groupBy(*by, "z", "y", "x").agg(F.sum("v").alias("v"))
    return out.where("v <> 0")


def bin_of(bins: int, lo: float, hi: float) -> Column:
    """The bin of v, null beyond lo to hi."""
    return F.when(F.col("v").between(lo, hi), F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / (hi - lo) * bins)).cast("int"))


def histogram(voxels: DataFrame, bins: int, lo: float, hi: float, *by: str) -> DataFrame:
    """Counts of `bins` equal bins and the share of values up to each."""
    counts = voxels.where(F.col("v").between(lo, hi)).groupBy(*by, bin_of(bins, lo, hi).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("bin")  # over at most `bins` rows of a group
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("cdf", upto / F.sum("n").over(Window.partitionBy(*by)))


def match_histogram(source: DataFrame, target: DataFrame) -> DataFrame:
    """For each bin of the source its place among the target's bins, linear between them (held at the ends).

    Both are histograms of one volume, so of at most `bins` rows.
    """
    w = Window.orderBy("cdf", "bin")
    legs = target.select(F.col("bin").alias("b0"), F.col("cdf").alias("c0"), F.lead("bin").over(w).alias("b1"), F.lead("cdf").over(w).alias("c1"))
    ends = target.agg(F.min(F.struct("cdf", "bin")).alias("first"), F.max(F.struct("cdf", "bin")).alias("last"))
    on = source.select(F.col("bin").alias("source_bin"), F.col("cdf").alias("c")).crossJoin(F.broadcast(ends))
    hit = on.join(F.broadcast(legs), (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1")), "left")
    mapped = F.when(F.col("c") <= F.col("first.cdf"), F.col("first.bin").cast("double")).when(F.col("c") >= F.col("last.cdf"), F.col("last.bin").cast("double")).otherwise(F.col("b0") + (F.col("c") - F.col("c0")) * (F.col("b1") - F.col("b0")) / (F.col("c1") - F.col("c0")))
    return hit.groupBy("source_bin").agg(F.max(mapped).alias("target"))


def between() -> Column:
    """How much two classes differ: n0 of n values, whose bins add up to s0 of s."""
    return F.col("n0") * (F.col("n") - F.col("n0")) * F.pow(F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0")), F.lit(2.0))


def otsu(voxels: DataFrame, bins: int, lo: float, hi: float, *by: str) -> DataFrame:
    """The bin after which two classes of values differ most (the first of equals)."""
    h = histogram(voxels, bins, lo, hi, *by)
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    h = h.select(*by, "bin", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("bin")).over(every).alias("s")).where("n0 < n")
    return h.withColumn("score", between()).groupBy(*by).agg(F.max_by("bin", F.struct("score", -F.col("bin"))).alias("bin"))


def line(rows: DataFrame, x: str, y: str, n: str, *by: str) -> DataFrame:
    """(by, slope, intercept) of rows that count n times; null where x does not vary."""
    sums = rows.groupBy(*by).agg(F.sum(n).cast("double").alias("w"), *(F.sum(F.col(n) * e).cast("double").alias(k) for k, e in (("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("sxy", F.col(x) * F.col(y)))))
    slope = (F.col("w") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("w") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return sums.withColumn("slope", slope).select(*by, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("w")).alias("intercept"))


def expression_mask(pixels: DataFrame, step: float = 0.05, slope: float = 0.4, window: int = 300, kernel: int = 5, most_rounds: int = 1000) -> DataFrame:
    """(z, y, x, v) of the pixels (z, y, x, signal, background; of one volume) that express, in deviations from the line of those that do not.

    A line is fitted to the pixels whose signal is beyond the first window of `window` levels in which the slope
    reaches `slope` (all pixels where no window does). As long as residuals above the line reach further than those
    below it, at the percentile 100 - step of either side, or the slope is not above its bound, those beyond the
    upper percentile are taken out and the line is fitted again, at most `most_rounds` times. Taken-out pixels above
    the line get their residual over the deviation of those that are left; then each plane's speckles go by a median
    of kernel x kernel pixels (none: 0), where everything beyond the plane counts as 0.

    Only how often each pair of levels occurs matters for the fit, so the rounds work on these counts, not on pixels.
    """
    counts = written(pixels.where("signal is not null and background is not null").groupBy(F.col("signal").cast("double").alias("signal"), F.col("background").cast("double").alias("background")).agg(F.count(F.lit(1)).alias("n")))
    steep = line(counts.withColumn("window", F.floor(F.col("signal") / window)), "signal", "background", "n", "window").where(F.col("slope") >= slope).agg(F.min("window").alias("first")).first()["first"]
    kept, q = counts.where(F.col("signal") >= (steep + 1) * window) if steep is not None else counts, 1 - step / 100
    for k in range(most_rounds + 1):
        fit = line(kept, "signal", "background", "n").first()
        if fit["slope"] is None:
            break
        rest = F.lit(fit["slope"]) * F.col("signal") + F.lit(fit["intercept"]) - F.col("background")
        sides = kept.select(F.abs(rest).alias("far"), (rest > 0).alias("above"), "n").where(F.col("far") > 0)
        ends = {r["above"]: r["value"] for r in quantiles(sides, "far", [q], "above", weight="n").collect()}
        above, below = ends.get(True), ends.get(False, 0.0)
        if above is None or k == most_rounds or (above < below and fit["slope"] > slope):
            break
        kept = written(kept.where(rest <= above))
    if fit["slope"] is None:
        return pixels.select("z", "y", "x", F.lit(0.0).alias("v")).limit(0)
    rest = F.lit(fit["slope"]) * F.col("signal") + F.lit(fit["intercept"]) - F.col("background")
    total = kept.select(rest.alias("r"), "n").agg(*(F.sum(F.col("n") * e).alias(c) for c, e in (("w", F.lit(1.0)), ("s", F.col("r")), ("ss", F.col("r") * F.col("r"))))).first()
    deviation = max(0.0, total["ss"] / total["w"] - (total["s"] / total["w"]) ** 2) ** 0.5
    if not deviation:
        return pixels.select("z", "y", "x", F.lit(0.0).alias("v")).limit(0)
    scores = counts.join(kept.select("signal", "background"), ["signal", "background"], "left_anti").where(rest > 0).select("signal", "background", (rest / deviation).alias("v"))
    same = (pixels["signal"].cast("double") == scores["signal"]) & (pixels["background"].cast("double") == scores["background"])
    found = pixels.join(scores, same).select("z", "y", "x", "v")
    half = kernel // 2
    return dense.by_block(found, (0, half, half), dense.median((0, half, half), gaps=0.0)).where("v > 0") if half else found
