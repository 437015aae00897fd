"""Cohorts of brains: pooled matrices, overlaps, effect sizes, scores, clusterings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmere.operators.graph import written


def voxel_overlap(points: DataFrame) -> DataFrame:
    """A2: in how many brains each integer voxel is positive; a brain counts once."""
    return points.groupBy(*(F.col(c).cast("int").alias(c) for c in "zyx")).agg(F.countDistinct("brain").alias("n_brains"))


def pivoted(counts: DataFrame, brains: list[str], index: tuple[str, ...] = ("id",), count: str = "cell_count") -> DataFrame:
    """Brains as columns, structures as rows, 0 where there is none. The brains are named, so no pass is needed to find them."""
    return counts.groupBy(*index).pivot("brain", brains).agg(F.sum(count)).fillna(0, [str(b) for b in brains])


def nonzero(matrix: DataFrame, column: str, value: str) -> DataFrame:
    """A long matrix without the columns that are zero throughout."""
    kept = matrix.groupBy(column).agg(F.max(F.abs(value)).alias("m")).where("m > 0").select(column)
    return matrix.join(kept, column, "left_semi")


def effect_size(values: DataFrame, group: str, value: str, a, b, log: bool = False, *by: str) -> DataFrame:
    """Cohen's d of group a against b, with pooled sample variance. With log, zeros of both sides are dropped and log10 is taken."""
    rows = values.where(F.col(group).isin(a, b))
    if log:
        rows = rows.where(F.col(value) != 0).withColumn(value, F.log10(value))
    one = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = rows.groupBy(*by).agg(one(a, F.count).alias("na"), one(b, F.count).alias("nb"), one(a, F.avg).alias("ma"), one(b, F.avg).alias("mb"), one(a, F.var_samp).alias("va"), one(b, F.var_samp).alias("vb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.nullif(F.col("na") + F.col("nb") - 2, F.lit(0)))
    return s.select(*by, ((F.col("ma") - F.col("mb")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Transposed left times right of long matrices (brain, column, value): one row for each pair of columns that share a brain."""
    l, r = left.select("brain", F.col("column").alias("i"), F.col("value").alias("a")), right.select("brain", F.col("column").alias("j"), F.col("value").alias("b"))
    return l.join(r, "brain").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def score_edges(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Edges between two short lists of nodes (node, value > 0) whose mean share of their list's maximum is above a threshold.

    Every pair can be an edge; but with u = a / max it holds only if v > 2 * threshold - u, so pairs are found by
    bands of v: each left node meets the bands from its bound up, not those below.
    """
    share = lambda d: d.where("value > 0").crossJoin(F.broadcast(d.agg(F.max("value").alias("top")))).select("node", (F.col("value") / F.col("top")).alias("u"))
    bands = 64
    l = share(left).select(F.col("node").alias("a"), F.col("u").alias("ua"))
    l = l.withColumn("band", F.explode(F.sequence(F.greatest(F.lit(0), F.least(F.lit(bands), F.floor((2 * threshold - F.col("ua")) * bands))).cast("int"), F.lit(bands))))
    r = share(right).select(F.col("node").alias("b"), F.col("u").alias("ub"), F.floor(F.col("u") * bands).cast("int").alias("band"))
    return l.join(r, "band").withColumn("score", (F.col("ua") + F.col("ub")) / 2).where(F.col("score") > threshold).select("a", "b", "score")


def bic(points: DataFrame, cluster: str, vector: str, dims: int) -> DataFrame:
    """Bayesian information criterion of a clustering under equal spherical variance."""
    parts = points.select(cluster, F.posexplode(vector).alias("i", "x"))
    spread = parts.groupBy(cluster, "i").agg(F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n"))
    per = spread.groupBy(cluster).agg(F.sum(F.col("var") * F.col("n")).alias("ss"), F.max("n").alias("n"))
    total = per.agg(F.sum("ss").alias("ss"), F.sum("n").alias("r"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    var = F.col("ss") / (F.col("r") - F.col("m")) / dims
    fit = F.col("nlogn") - F.col("r") * F.log("r") - F.col("r") * dims / 2 * F.log(2 * 3.141592653589793 * var) - (F.col("r") - F.col("m")) * dims / 2
    return total.select((fit - 0.5 * F.col("m") * F.log("r") * (dims + 1)).alias("bic"))


def distances(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x and y, whose squared lengths are xx and yy, by one matrix product; where that would cancel digits, by differences."""
    with np.errstate(all="ignore"):
        size = xx[:, None] + yy[None]
        square = (-2 * x) @ y.T
        square += size
        size *= 1e-4
        near = ~(square > size)  # or not finite
        if near.any():
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 16):
                own = slice(k, k + (1 << 16))
                square[i[own], j[own]] = ((x[i[own]] - y[j[own]]) ** 2).sum(axis=1)
        return np.sqrt(square, out=square)


#: A task gives sums of points by cluster on as soon as it holds more than these.
SUMS = 1 << 21


def _blocks_of_points(points: DataFrame, cluster: str, vector: str, idx: str, block: int) -> DataFrame:
    """(block, rows): about `block` points a row, dealt by a hash of their id; rows are (id, c, x). Points without an id or a vector meet none."""
    x = F.col(vector)
    rows = points.select(F.col(idx).cast("long").alias("id"), F.col(cluster).alias("c"), (x if "float" in points.schema[vector].dataType.simpleString() else x.cast("array<double>")).alias("x"))
    rows = rows.where("id is not null and x is not null")
    blocks = max(1, -(-rows.count() // block))
    return written(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "c", "x")).alias("rows")))


def silhouette(points: DataFrame, cluster: str, vector: str, idx: str, block: int = 1024) -> DataFrame:
    """Mean silhouette with plain Euclidean distance.

    Every pair of points is measured, which the measure demands. Points are written once, as blocks of about `block`
    by a hash of their id, and a cartesian product reads them again, so no point is copied for the blocks that it
    meets. A task measures its blocks against all others by matrix products, one after the other, and gives on only
    the sums by point and cluster (whenever it holds more than SUMS).
    """
    blocks = _blocks_of_points(points, cluster, vector, idx, block)
    kind = points.schema[cluster].dataType.simpleString()
    left = blocks.select("block", F.col("rows").alias("asked"))
    # each part of the left side meets all parts of the other one, in parts that follow each other
    met = left.join(blocks.select("rows").hint("shuffle_replicate_nl")).coalesce(max(1, left.rdd.getNumPartitions()))

    def side(rows: pa.StructArray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        x = rows.field("x")
        x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
        return rows.field("id"), rows.field("c"), x, (x * x).sum(axis=1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0  # by block: its points, and their sums and numbers by cluster

        def out() -> Iterator[pa.RecordBatch]:
            for (ids, c, _, _), sums in held.values():
                for other, (total, n) in sums.items():
                    yield pa.RecordBatch.from_arrays([ids, c, pa.array([other] * len(ids), c.type), pa.array(total), pa.array(n)], names=["id", "c", "other", "total", "n"])

        for batch in batches:
            for block, asked, rows in zip(batch["block"].to_pylist(), batch["asked"], batch["rows"]):
                if block not in held:
                    m = len(asked)
                    held[block] = (side(asked.values), {None: (np.zeros(m), np.zeros(m, dtype=np.int64))})  # a cluster without a name has no members
                    size += m
                (ids, _, x, xx), sums = held[block]
                others, names, y, yy = side(rows.values)
                number: dict = {}
                codes = np.array([-1 if c is None else number.setdefault(c, len(number)) for c in names.to_pylist()])
                order = np.argsort(codes, kind="stable")[(codes < 0).sum() :]
                if not len(order):
                    continue
                mine, others, codes, y, yy = ids.to_numpy(), others.to_numpy()[order], codes[order], y[order], yy[order]
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                total, n = np.empty((len(x), len(number))), np.tile(np.diff(np.r_[starts, len(codes)]), (len(x), 1))
                own = np.isin(mine, others)
                for k in range(0, len(x), 64):
                    e = slice(k, k + 64)
                    d = distances(x[e], y, xx[e], yy)
                    for i in np.flatnonzero(own[e]):  # a point does not meet rows of its own id
                        same = others == mine[k + i]
                        d[i, same] = 0
                        n[k + i] -= np.add.reduceat(same.astype(np.int64), starts)
                    total[e] = np.add.reduceat(d, starts, axis=1)
                for name, i in number.items():
                    if name not in sums:
                        sums[name] = (np.zeros(len(x)), np.zeros(len(x), dtype=np.int64))
                        size += len(x)
                    sums[name][0][:] += total[:, i]
                    sums[name][1][:] += n[:, i]
                if size > SUMS:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    sums = met.mapInArrow(measure, f"id long, c {kind}, other {kind}, total double, n long")
    bare = points.where(F.col(idx).isNotNull() & F.col(vector).isNull())
    sums = sums.unionByName(bare.select(F.col(idx).cast("long").alias("id"), F.col(cluster).alias("c"), F.lit(None).cast(kind).alias("other"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n")))
    means = sums.groupBy("id", "c", "other").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    ab = means.groupBy("id", "c").agg(F.max(F.when(F.col("c") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("other"), F.col("d"))).alias("b"))
    return ab.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def kmeans_sweep(points: DataFrame, features: str, ks: list[int], seed: int = 1) -> DataFrame:
    """Cost and cluster sizes of k-means for several k (features is a vector column)."""
    from pyspark.ml.clustering import KMeans

    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol=features).fit(points)
        out.append((k, float(model.summary.trainingCost), [int(n) for n in model.summary.clusterSizes]))
    return points.sparkSession.createDataFrame(out, "k int, cost double, sizes array<int>")


def running_averages(log: DataFrame, every: int) -> DataFrame:
    """sum(num) / sum(den) of each phase and metric in flushes of `every` iterations."""
    return log.groupBy("phase", "metric", F.floor(F.col("iter") / every).alias("flush")).agg((F.sum("num") / F.sum("den")).alias("value"))


def subsampled(log: DataFrame, every: int) -> DataFrame:
    """W13."""
    return log.where(F.col("iter") % every == 0)


def balance(labels: DataFrame, value: str) -> DataFrame:
    """Weights that even out two classes; the positive share is held within 0.05 and 0.95."""
    share = labels.agg(F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("p"))
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("p")))
    return share.select((1 / (2 * p)).alias("w_positive"), (1 / (2 * (1 - p))).alias("w_negative"))


def losses(pairs: DataFrame, logit: str, target: str, weight: str) -> DataFrame:
    """Weighted sums of binary cross entropy with logits and of squared errors."""
    x, t, w = F.col(logit), F.col(target), F.col(weight)
    bce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    return pairs.agg(F.sum(w * bce).alias("bce"), F.sum(w * (x - t) * (x - t)).alias("mse"), F.sum(w).alias("n"))


def regression(points: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """A12."""
    return points.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def p_between(rows: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """An open interval."""
    return rows.where((F.col(column) > lo) & (F.col(column) < hi))


def ranked(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Members of a group by value, largest first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), *(c for c in rows.columns if c not in (value, *by)))))


def first_match(rows: DataFrame, condition, order: list[str], *by: str) -> DataFrame:
    """Of each group the first row, in a stated order, that meets a condition; nothing is sorted."""
    rest = [c for c in rows.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return rows.where(condition).groupBy(*by).agg(best).select(*by, "first.*")
