"""Event-time windows, sessions and deduplication that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def late(rows: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return rows.withWatermark(ts, delay) if delay and rows.isStreaming else rows


def tumbling(rows: DataFrame, ts: str, width: str, by: list[str], *aggs: Column, delay: str | None = "10 minutes") -> DataFrame:
    return late(rows, ts, delay).groupBy(F.window(ts, width), *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[c for c in _names(aggs)])


def hopping(rows: DataFrame, ts: str, width: str, slide: str, by: list[str], *aggs: Column, delay: str | None = "10 minutes") -> DataFrame:
    return late(rows, ts, delay).groupBy(F.window(ts, width, slide), *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *_names(aggs))


def sessions(rows: DataFrame, ts: str, gap: str, by: list[str], *aggs: Column, delay: str | None = "10 minutes") -> DataFrame:
    return late(rows, ts, delay).groupBy(F.session_window(ts, gap), *by).agg(*aggs).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *_names(aggs))


def unique(rows: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; on a stream within the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def publish_window(start: Column, end: Column, after: Column, until: Column) -> tuple[Column, Column]:
    """A chunk's times held within what may be published."""
    return F.greatest(start, after), F.least(end, until)


def _names(aggs: tuple[Column, ...]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]
