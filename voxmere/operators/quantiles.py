"""Exact quantiles without a sort and without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmere.operators.graph import written

BINS = 1024


def quantiles(rows: DataFrame, value: str, qs: list[float], *by: str, weight: str | None = None) -> DataFrame:
    """(by, q, value): quantiles with linear interpolation, of each group.

    A quantile lies between two ranks. For each rank the range that holds it is cut into BINS bins, which are counted
    (BINS counts a task, wherever the rows are), and the bin that holds the rank is the next range, narrowed to the
    values that are in it; three or four passes single out one value. Rows count `weight` times, if given. Null and
    NaN values are left out, groups without others are absent; values are finite.
    """
    base = rows.select(*by, F.col(value).cast("double").alias("v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("n")).where("v is not null and not isnan(v) and n > 0")
    ends = base.groupBy(*by).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("total > 0")
    wanted = ends.withColumn("q", F.explode(F.array(*map(F.lit, map(float, qs))))).withColumn("at", F.col("q") * (F.col("total") - 1))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("at").alias("rank"))))
    found = written(wanted.withColumn("s", sides).select(*by, "q", (F.col("at") - F.floor("at")).alias("part"), "s.side", "s.rank", F.lit(0).cast("long").alias("below"), "lo", "hi"))
    names = found.columns
    while not (ranges := found.where("lo < hi")).isEmpty():
        # without groups there are two ranges for each quantile
        met = base.join(ranges, list(by)) if by else base.crossJoin(F.broadcast(ranges))
        # halves first, so that no difference overflows
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        binned = met.where("v between lo and hi").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int"))
        counts = binned.groupBy(*by, "q", "part", "side", "rank", "below", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        order = Window.partitionBy(*by, "q", "side").orderBy("bin")  # at most BINS rows
        upto = counts.withColumn("upto", F.col("below") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        chosen = upto.where("upto > rank and upto - n <= rank").withColumn("below", F.col("upto") - F.col("n"))
        found = written(found.where("lo = hi").select(*names).unionByName(chosen.select(*names)))
    a, b = (F.max(F.when(F.col("side") == k, F.col("lo"))) for k in (0, 1))
    return found.groupBy(*by, "q").agg((a + (b - a) * F.max("part")).alias("value"))


def with_quantiles(rows: DataFrame, value: str, named: dict[str, float], *by: str) -> DataFrame:
    """A row for each group with its quantiles as columns."""
    found = quantiles(rows, value, list(named.values()), *by)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name) for name, q in named.items()))
