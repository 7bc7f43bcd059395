"""Incremental processing: pending revisits, mask filling, latest values, event windows.

What has been done is known by keys (and by the stream's checkpoint), never by a
position in a time axis, so nothing is skipped or done twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.timeseries import run_version


def pending(revisits: DataFrame, done: DataFrame, on: list[str], overwrite: bool = False) -> DataFrame:
    """Revisits that are not done yet; all with ``overwrite``. None is an empty result."""
    return revisits if overwrite else revisits.join(done.select(*on).distinct(), on, "left_anti")


def chosen(revisits: DataFrame, dates: DataFrame, on: list[str]) -> DataFrame:
    """Exactly the asked revisits; a date that is not there is a ValueError."""
    if not dates.select(*on).distinct().join(revisits, on, "left_anti").isEmpty():
        raise ValueError("unknown dates")
    return revisits.join(dates.select(*on), on, "left_semi")


def fill_masks(stream: DataFrame, classify: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], checkpoint: str):
    """Classify new revisits as files arrive, then stop. ``write`` must replace whole partitions, so that a repeated batch changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        write(classify(df))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(events: DataFrame, keys: list[str], value: str = "area", run_id: str = "run_id") -> DataFrame:
    """Running latest run of each key; a later version supersedes (update or complete mode)."""
    v = run_version(F.col(run_id))
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(v.isNotNull(), F.coalesce(v, F.lit("")), F.col(value))).alias(value))


def windowed(events: DataFrame, time: str, key: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of tumbling or sliding windows. Windows start at multiples of their length since 1970, not at a key's first date."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = d.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    d = events.withWatermark(time, late) if events.isStreaming else events
    out = d.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def append_each(stream: DataFrame, path: str, checkpoint: str):
    """Append new metric rows as they come."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
