"""A session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "voxmere", master: str | None = None, **options: str) -> SparkSession:
    """Adaptive execution on (it sizes shuffles, splits skewed joins and picks broadcasts by measured size), UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in options.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
