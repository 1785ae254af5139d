"""Signal statistics over event-time windows of a stream; the same functions take batch tables.

An extension: the engines that this library matches work on finite arrays only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, keys: list[str], ts: str, value: str, size: str, slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Count, mean, deviation, greatest and least of ``value`` by keys and window; rows later than ``late`` may be dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    v = F.col(value)
    marked = rows.withWatermark(ts, late) if rows.isStreaming else rows
    found = marked.groupBy(*keys, w).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"))
    return found.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std", "max", "min")


def sessions(rows: DataFrame, keys: list[str], ts: str, value: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """The same over sessions that end after a gap without rows."""
    marked = rows.withWatermark(ts, late) if rows.isStreaming else rows
    found = marked.groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return found.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")
