"""Time series: one value for each key, resampling, rolling, lagging, filling, folds.

Windows are partitioned by the series' key, so that a shuffle by key serves all
windows over the same key. Where a window would only pick a row, an aggregate with
partial combination is used instead of a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_version(run_id: Column) -> Column:
    """Second part of a run id; compared as text. Null where there is none."""
    return F.get(F.split(run_id, "_"), F.lit(1))


def latest_run(ts: DataFrame, keys: list[str], value: str = "area", run_id: str = "run_id", tie: str | None = None) -> DataFrame:
    """The value of the greatest run version of each key; a missing version is the least, ties go to the greatest ``tie`` or value.

    ``max_by`` combines before the shuffle and needs no sort.
    """
    version = F.coalesce(run_version(F.col(run_id)), F.lit(""))
    order = F.struct(run_version(F.col(run_id)).isNotNull(), version, F.col(tie or value))
    return ts.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def pick(ts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return ts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resample(ts: DataFrame, keys: str | list[str], date: str, value: str, days: int = 30, fill: float | None = 0.0) -> DataFrame:
    """Mean of each bin of ``days`` days from the key's own first date; empty bins are filled, means cut to whole numbers.

    Rows combine by key and date before the shuffle, so that only as many rows as a
    key has dates are windowed by key, however many it has. A gap is the distance to
    the next bin, exploded.
    """
    keys = [keys] if isinstance(keys, str) else keys
    w = Window.partitionBy(*keys)
    d = ts.groupBy(*keys, F.to_date(date).alias("_d")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    d = d.withColumn("_d0", F.min("_d").over(w))
    number = F.floor(F.date_diff("_d", "_d0") / days).cast("int").alias("_bin")
    bins = d.groupBy(*keys, "_d0", number).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("_mean"))
    bins = bins.withColumn("_next", F.lead("_bin").over(w.orderBy("_bin")))
    out = bins.withColumn("_at", F.explode(F.sequence("_bin", F.coalesce(F.col("_next") - 1, F.col("_bin")))))
    v = F.when(F.col("_at") == F.col("_bin"), F.col("_mean"))
    if fill is not None:
        v = F.coalesce(v, F.lit(fill))
    return out.select(*keys, F.date_add("_d0", F.col("_at") * days).alias(date), v.cast("long").alias(value))


def rolling_rows(ts: DataFrame, keys: list[str], order: list[str], value: str, n: int, out: str, how: str = "avg", full: bool = True) -> DataFrame:
    """Aggregate of the last ``n`` rows; null before there are ``n`` where ``full``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how](value).over(w)
    return ts.withColumn(out, F.when(F.count(F.lit(1)).over(w) == n, agg) if full else agg)


def rolling_days(ts: DataFrame, keys: list[str], date: str, value: str, days: int, out: str) -> DataFrame:
    """Mean over the ``days`` days up to and with each date."""
    day = F.unix_date(F.to_date(date))
    return ts.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(day).rangeBetween(1 - days, 0)))


def lags(ts: DataFrame, keys: list[str], order: list[str], value: str, steps: list[int], prefix: str = "lag") -> DataFrame:
    """``lag_k`` for positive and ``lead_k`` for negative steps, over one sort."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = {(f"{prefix}_{k}" if k >= 0 else f"lead_{-k}"): F.lag(value, k).over(w) for k in steps}
    return ts.withColumns(new)


def differences(ts: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Steps of a running total; the first value is its own step."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return ts.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def daily(ts: DataFrame, keys: list[str], date: str) -> DataFrame:
    """One row for each key and day from its first to its last date."""
    span = ts.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(date))
    return grid.join(ts, [*keys, date], "left")


def forward_fill(ts: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value that is not null; leading nulls stay."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ts.withColumn(out, F.last(value, ignorenulls=True).over(w))


def interpolate(ts: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Straight lines between values, rows taken as equally spaced; leading nulls stay, trailing ones keep the last value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).cast("double").alias("v")))
    t = ts.withColumn("_i", F.row_number().over(w)).withColumn("_p", point)
    t = t.withColumn("_a", F.last("_p", ignorenulls=True).over(back)).withColumn("_b", F.first("_p", ignorenulls=True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / F.nullif(F.col("_b.i") - F.col("_a.i"), F.lit(0))
    return t.withColumn(out, F.when(F.col("_a").isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(line, F.col("_a.v")))).drop("_i", "_p", "_a", "_b")


def folds(ts: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """(fold, role) of an expanding split: fold k tests the k-th of ``n`` equal tails and trains on all rows before it.

    Tails have ``floor(rows / (n + 1))`` rows, the last at the end of the series.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    t = ts.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    t = t.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_t", F.floor(F.col("_n") / (n + 1)))
    begin = F.col("_n") - (n - F.col("fold")) * F.col("_t")
    role = F.when(F.col("_i") <= begin, "train").when(F.col("_i") <= begin + F.col("_t"), "test")
    return t.withColumn("role", role).where("role is not null").drop("_i", "_n", "_t")


def monthly_mean(ts: DataFrame, date: str, value: str, out: str) -> DataFrame:
    """Mean by month of the means of each date."""
    each = ts.groupBy(date).agg(F.avg(value).alias("_v"))
    return each.groupBy(F.trunc(date, "month").alias("month")).agg(F.avg("_v").alias(out))


def neighbour_ratios(ts: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Neighbours over the value, sum and mean of three, and both real differences."""
    w = Window.partitionBy(*keys).orderBy(*order)
    left, right, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return ts.withColumns({"left_ratio": F.try_divide(left, v), "right_ratio": F.try_divide(right, v), "sum_3": left + v + right, "mean_3": (left + v + right) / 3, "diff_left": v - left, "diff_right": right - v})


def forecast_sums(df: DataFrame, forecasts: list[str], observed: list[str]) -> DataFrame:
    """``<f>_sum_2`` and ``<f>_sum_3``: running sums over neighbouring steps; before the first forecast stand the latest ``observed`` (newest first)."""
    row = [*reversed(observed[:2]), *forecasts]
    pad = len(observed[:2])
    new = {}
    for i, f in enumerate(forecasts):
        for k in (2, 3):
            new[f"{f}_sum_{k}"] = sum((F.col(c) for c in row[max(0, i + pad - k + 1) : i + pad]), F.lit(0.0)) + F.col(f)
    return df.withColumns(new)
