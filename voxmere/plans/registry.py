"""Queries over the driver's tables, one or more for each operator, with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmere.plans import atlas_queries, composed_queries, stream_queries, volume_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**atlas_queries.QUERIES, **volume_queries.QUERIES, **composed_queries.QUERIES, **stream_queries.QUERIES}
ORACLES: dict[str, str] = {**atlas_queries.ORACLES, **volume_queries.ORACLES, **composed_queries.ORACLES, **stream_queries.ORACLES}
