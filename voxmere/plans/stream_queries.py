"""Streaming operators over the events table, read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.operators.graph import checkpoint_dir
from voxmere.plans import projections as P
from voxmere.streaming import monitors


def _folder(s: SparkSession) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.readStream.schema(P.table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _averages(s: SparkSession, d: str) -> DataFrame:
    log = _events(s, d).selectExpr("case when event_id % 5 = 0 then 'test' else 'train' end as phase", "event_id as iter", "event_type as metric", "value as num", "1.0D + event_id % 3 as den")
    return monitors.as_table(monitors.running_averages(log, 500), _folder(s)).select("phase", "metric", F.col("flush").cast("long").alias("flush"), F.round("value", 6).alias("value"))


def _hours(s: SparkSession, d: str) -> DataFrame:
    counted = monitors.as_table(monitors.windowed(_events(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", None, "event_type"), _folder(s))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def _completed(s: SparkSession, d: str) -> DataFrame:
    """Users as jobs: each is done once, however many events report it."""
    done = _events(s, d).select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"))
    return monitors.as_table(monitors.completed(done, "job", "at", "400 days"), _folder(s), "append").select("job")


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Voxels that arrive several times, merged by maximum."""
    stream = s.readStream.schema(P.table(s, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    voxels = stream.selectExpr("'a' as volume_id", "cast(l_partkey % 60 as int) as z", "cast(l_suppkey % 40 as int) as y", "cast(l_orderkey div 100 as int) as x", "(l_quantity - 1) / 49 as v")
    folder = _folder(s)
    monitors.merge_patches(voxels, f"{folder}/merged", f"{folder}/checkpoint").awaitTermination()
    return monitors.merged_so_far(s, f"{folder}/merged").drop("volume_id")


def _followed(s: SparkSession, d: str) -> DataFrame:
    """Events as cells of planes of a volume for each type, an hour to a plane; objects are followed as the planes come."""
    cells = _events(s, d).selectExpr("event_type as volume_id", "cast(unix_timestamp(ts) div 3600 - unix_timestamp(timestamp'2024-01-01 00:00:00') div 3600 as int) as z", "cast(user_id % 40 as double) as y", "floor(value) % 50 * 1.0D as x", "cast(ts as timestamp) as time")
    return monitors.as_table(monitors.follow_objects(cells, 3.0, "0 seconds", 0), _folder(s), "append").drop("late")


QUERIES = {
    "t3_followed": _followed,
    "t4_completed": _completed,
    "t5_merged": _merged,"t2_streaming_averages": _averages, "t2_tumbling_windows": _hours}
ORACLES = {
    "t4_completed": "select distinct user_id as job from events",
    "t5_merged": f"with {P.VOXELS} select z, y, x, v from voxels",
    "t2_streaming_averages": f"with {P.LOG} select phase, metric, iter // 500 as flush, round(sum(num) / sum(den), 6) as value from log group by 1, 2, 3",
    "t2_tumbling_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2",
}
