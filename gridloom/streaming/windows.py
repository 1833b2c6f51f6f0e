"""The same reducers over unbounded tables: event-time windows with a watermark for late rows, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.reducers import Group
from gridloom.schema import VALUE


def windowed(stream: DataFrame, reducers: dict, time: str, by: list[str], value: str = VALUE, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling windows (sliding ones with `slide`): a column for each reducer. Rows later than `late` are dropped, so state stays bounded."""
    window = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    group = Group(F.col(value), F.col(time))
    rows = stream.withWatermark(time, late).groupBy(window.alias("_w"), *by)
    return rows.agg(*[r(group).alias(n) for n, r in reducers.items()]).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *reducers)


def sessions(stream: DataFrame, reducers: dict, time: str, by: list[str], value: str = VALUE, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of rows that follow each other within the gap."""
    group = Group(F.col(value), F.col(time))
    rows = stream.withWatermark(time, late).groupBy(F.session_window(F.col(time), gap).alias("_w"), *by)
    return rows.agg(*[r(group).alias(n) for n, r in reducers.items()]).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *reducers)
