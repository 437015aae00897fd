"""Streaming analogs: running averages, completeness of jobs, objects followed plane by plane, rate-limited reads."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxmere.operators.raster import by_volume


def files_as_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 10) -> DataFrame:
    """New Parquet files as micro-batches of at most so many files, the bounded queue between producer and consumer."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_averages(log: DataFrame, every: int) -> DataFrame:
    """sum(num) / sum(den) of each phase, metric and flush of `every` iterations; state is two sums a key."""
    return log.groupBy("phase", "metric", F.floor(F.col("iter") / every).alias("flush")).agg((F.sum("num") / F.sum("den")).alias("value"))


def windowed(events: DataFrame, time: str, late: str, size: str, slide: str | None = None, *by: str) -> DataFrame:
    """Event-time windows with a watermark: tumbling, or sliding with `slide`."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, late: str, gap: str, *by: str) -> DataFrame:
    """Event-time sessions that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def completed(done: DataFrame, job: str, time: str, late: str) -> DataFrame:
    """T4: each finished job once, however often it is reported within the watermark."""
    return done.withWatermark(time, late).dropDuplicatesWithinWatermark([job])


_OBJECT = "volume_id string, object_id long, z_first int, z_last int, n_planes int, y double, x double, late long"
_OPEN = "number long, plane int, late long, open array<array<double>>"


#: Closed objects leave in tables of so many rows.
_ROWS = 1 << 16


class _Free:
    """Objects of a plane by their places, and places by squares of side `most`: a cell looks at the places around it, not at all objects."""

    def __init__(self, objects: list, most: float):
        self.most, self.places, self.squares = most, {}, {}
        for o in objects:
            self.places.setdefault((o[4], o[5]), []).append(o)
        for place, here in self.places.items():
            heapify(here)
            if math.isfinite(place[0]) and math.isfinite(place[1]):
                self.squares.setdefault(tuple(self._range(c, 0.0)[0] for c in place), set()).add(place)

    def _range(self, c: float, most: float) -> range:
        """The squares of an axis that reach from c - most to c + most, or a little further, as differences are rounded."""
        if not math.isfinite(self.most):
            return range(1)
        reach = most * (1 + 1e-9) + (abs(c) * 1e-14 if most else 0.0)
        return range(math.floor((c - reach) / self.most), math.floor((c + reach) / self.most) + 1)

    def take(self, y: float, x: float) -> tuple | None:
        """The nearest object within `most`, the first of equals; it is free no more."""
        if self.most <= 0 or not (math.isfinite(y) and math.isfinite(x)):
            return None
        place = (y, x)
        if place not in self.places:
            best = None
            for sy in self._range(y, self.most):
                for sx in self._range(x, self.most):
                    for p in self.squares.get((sy, sx), ()):
                        dy, dx = y - p[0], x - p[1]
                        if -self.most <= dy < self.most and -self.most <= dx < self.most:
                            found = (dy**2 + dx**2, self.places[p][0][0], p)
                            best = found if best is None or found < best else best
            if best is None:
                return None
            place = best[2]
        here = self.places[place]
        o = heappop(here)
        if not here:
            del self.places[place]
            self.squares[tuple(self._range(c, 0.0)[0] for c in place)].discard(place)
        return o

    def rest(self) -> list:
        return [o for here in self.places.values() for o in here]


class ObjectFollower(StatefulProcessor):
    """State of a volume: its open objects, the plane it has come to, and how many cells came too late for theirs."""

    def __init__(self, most: float, quiet_ms: int):
        self.most, self.quiet_ms = most, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("followed", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, plane, late, opened = self.state.get() if self.state.exists() else (0, None, 0, [])
        opened, closed = [tuple(o) for o in opened], []
        cells = pd.concat([r[["z", "y", "x", "time"]] for r in rows])
        ended = cells["z"].isna().any()
        seen = cells["time"].max()
        cells = cells.dropna(subset=["z", "y", "x"]).sort_values(["z", "y", "x"])
        for z, here in cells.groupby("z"):
            if plane is not None and z < plane:
                late += len(here)
                continue
            plane = int(z)
            active = [o for o in opened if o[2] in (z - 1, z)]
            closed += [o for o in opened if o[2] < z - 1]
            free, grown = _Free([o for o in active if o[2] == z - 1], self.most), [o for o in active if o[2] == z]
            for y, x in zip(map(float, here["y"]), map(float, here["x"])):
                if o := free.take(y, x):
                    grown.append((o[0], o[1], int(z), o[3] + 1, y, x))
                else:
                    grown.append((number, int(z), int(z), 1, y, x))
                    number += 1
            # an object may still grow in this plane: its cells may come in several batches
            opened = grown + free.rest()
            if len(closed) >= _ROWS:  # late cells come first, so their number is final
                yield self._rows(key, closed, late)
                closed = []
        if ended:
            closed, opened = closed + opened, []
        self.state.update((number, plane, late, [list(map(float, o)) for o in opened]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if opened and not pd.isna(seen):
            due = int(pd.Timestamp(seen).timestamp() * 1000) + self.quiet_ms
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._rows(key, closed, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, plane, late, opened = self.state.get()
        self.state.update((number, plane, late, []))
        yield self._rows(key, opened, late)

    def close(self) -> None:
        pass

    def _rows(self, key, objects: list, late: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], int(o[0]), int(o[1]), int(o[2]), int(o[3]), o[4], o[5], late) for o in objects], columns=["volume_id", "object_id", "z_first", "z_last", "n_planes", "y", "x", "late"])


def follow_objects(cells: DataFrame, most: float, late: str = "1 minute", quiet_ms: int = 60_000) -> DataFrame:
    """2-D cells (volume_id, z, y, x, time) in rising order of z joined to objects; an object is emitted when it can grow no more.

    A plane's cells each go to the nearest open object of the plane before that is within `most` on both axes, in
    order of (y, x); others begin an object. An object is closed by cells two planes on, by a row without a z, which
    ends the volume, or by an event-time timer when its volume has been quiet for `quiet_ms`. Cells of planes before
    the last one seen are not followed; `late` counts those of the volume so far.
    """
    cells.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one with timers
    return cells.withWatermark("time", late).groupBy("volume_id").transformWithStateInPandas(statefulProcessor=ObjectFollower(most, quiet_ms), outputStructType=_OBJECT, outputMode="Append", timeMode="EventTime")


def merge_patches(stream: DataFrame, folder: str, checkpoint: str):
    """Finished patches' voxels (volume_id where there are several volumes, z, y, x, v) merged by maximum; each micro-batch is written under its own folder, so a repeated batch replaces itself. merged_so_far reads them."""
    keys = [*by_volume(stream), "z", "y", "x"]

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.max("v").alias("v")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_so_far(spark: SparkSession, folder: str, schema: str = "volume_id string, z int, y int, x int, v double") -> DataFrame:
    """T5: the maximum over all micro-batches of merge_patches."""
    batches = _batches(spark, folder, schema)
    return batches.groupBy(*(c for c in batches.columns if c not in ("v", "batch"))).agg(F.max("v").alias("v"))


def _batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The micro-batches' tables in a folder, with `batch`; none if there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    empty = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return empty
    return spark.read.schema(empty.schema).parquet(folder)


def as_table(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its result; each micro-batch is written where all executors can read it.

    With `complete` the last batch is the result, with `append` all of them are; those of earlier runs with the same
    folder count, since the stream goes on where they ended.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = _batches(stream.sparkSession, f"{folder}/result", stream.schema)
    if mode != "append":
        found = found.where(F.col("batch") == F.lit(found.agg(F.max("batch")).first()[0]))
    return found.drop("batch")
