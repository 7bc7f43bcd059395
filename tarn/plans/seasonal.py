"""Seasonal precipitation forecasts as daily series, and month-start means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.timeseries import differences, rolling_days


def daily(cube: DataFrame) -> DataFrame:
    """(date, tp) from cumulative totals (time, step, member, latitude, longitude, tp).

    Each month's own forecast gives its days: mean over members and cells of each
    step, then the steps of the running total; the first day is its own total.
    """
    own = cube.where((F.day("time") == 1) & (F.col("step") < F.day(F.last_day("time"))))
    mean = own.groupBy("time", "step").agg(F.avg("tp").alias("tp"))
    d = differences(mean, ["time"], ["step"], "tp", "one")
    return d.select(F.date_add("time", F.col("step").cast("int")).alias("date"), F.col("one").alias("tp"))


def month_starts(ts: DataFrame, keys: list[str], date: str, value: str, days: int = 30) -> DataFrame:
    """The mean of the ``days`` days up to each first of a month."""
    return rolling_days(ts, keys, date, value, days, "mean").where(F.day(date) == 1).select(*keys, date, "mean")
