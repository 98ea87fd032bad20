"""Windowed aggregates with watermarks. On a table the watermark does nothing and the result is the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _windowed(rows: DataFrame, window: Column, time: str, late: str, keys: list[str], aggregates: tuple[Column, ...]) -> DataFrame:
    out = rows.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def tumbling(rows: DataFrame, time: str, width: str, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    return _windowed(rows, F.window(time, width), time, late, keys, aggregates)


def sliding(rows: DataFrame, time: str, width: str, step: str, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    return _windowed(rows, F.window(time, width, step), time, late, keys, aggregates)


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    return _windowed(rows, F.session_window(time, gap), time, late, keys, aggregates)


def distinct_within(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; on a table, the first by time of all."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    from ..operators.merge import first_seen

    return first_seen(rows.withColumn("_k", F.struct(*keys)), "_k", [time]).drop("_k")
