"""Reductions of masks and cubes to areas, statistics and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = ("pixel", "meter")


def area(df: DataFrame, keys: list[str], value: str = "mask", unit: str = "pixel", resolution: float | None = 1, out: str = "area") -> DataFrame:
    """Count of pixels above 0 for each key, times the squared resolution in metres."""
    if unit not in UNITS:
        raise AssertionError(f"unit must be one of {UNITS}")
    n = F.count_if(F.col(value) > 0)
    if unit == "meter":
        if resolution is None:
            raise AssertionError("resolution is mandatory when unit is 'meter'")
        n = n * F.lit(resolution**2)
    return df.groupBy(*keys).agg(n.alias(out))


def class_count(df: DataFrame, keys: list[str], value: str, label: int = 1, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(value) == label).alias(out))


#: Reducers by name; ``percentile_disc`` is the lower median.
STATS = {
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "std": lambda c: F.stddev_pop(c),
    "median": lambda c: F.median(c),
    "lower_median": lambda c: F.expr(f"percentile_disc(0.5) within group (order by `{c}`)"),
}


def stat_per_band(df: DataFrame, outer: list[str], frame: list[str], value: str, stat: str = "mean", out: str = "stat") -> DataFrame:
    """Statistic over the pixels of each frame, then the plain mean over frames; both levels combine before their shuffle."""
    per = df.groupBy(*outer, *frame).agg(STATS[stat](value).alias("_s"))
    return per.groupBy(*outer).agg(F.avg("_s").alias(out))


def composite(df: DataFrame, pixel: list[str], value: str, stat: str = "median", out: str = "value") -> DataFrame:
    """Statistic over time for each pixel and band; nulls are skipped."""
    return df.groupBy(*pixel).agg(STATS[stat](value).alias(out))


def extent(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def same_size(df: DataFrame, width: str, height: str) -> int:
    """The one size of square tiles; anything else is an AssertionError."""
    r = df.agg(F.count_if(F.col(width) != F.col(height)).alias("odd"), F.count_distinct(width).alias("n"), F.max(width).alias("size")).collect()[0]
    if r["odd"]:
        raise AssertionError("tiles must be square")
    if r["n"] != 1:
        raise AssertionError("all sizes must be the same and not empty")
    return int(r["size"])


def nonzero_fraction(value: Column) -> Column:
    return F.count_if(value != 0) / F.count(F.lit(1))


def keep_filled(df: DataFrame, keys: list[str], values: list[str], percentage: float) -> DataFrame:
    """Chips of which any of ``values`` is non-zero in at least 1 - percentage of the pixels."""
    test = None
    for v in values:
        t = nonzero_fraction(F.col(v)) >= 1 - percentage
        test = t if test is None else test | t
    keep = df.groupBy(*keys).agg(test.alias("_k")).where("_k").select(*keys)
    return df.join(keep, keys, "left_semi")


def percentile_stretch(df: DataFrame, keys: list[str], value: str, low: float = 0.02, high: float = 0.98, out: str = "stretched") -> DataFrame:
    from tarn.functions.pixel import stretched

    p = df.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    return df.join(p, keys).withColumn(out, stretched(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles, maximum.

    Quartiles are picked by rank: values are counted by the leading bits of their
    order-preserving code, and only the values of the one or two cells that a rank
    falls into are ranked. No task merges all distinct values.
    """
    d = df.select(F.col(value).cast("double").alias("v")).where("v is not null").withColumn("cell", _cell(F.col("v")))
    total = d.agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows
    cells = d.groupBy("cell").agg(F.count("v").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    at = total.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), ((F.col("count") - 1) * q).alias("rank")) for k, q in ((25, 0.25), (50, 0.5), (75, 0.75))))).alias("q")).select("q.*")
    want = at.select("k", F.explode(F.array(F.struct(F.floor("rank").alias("at"), (1 - (F.col("rank") - F.floor("rank"))).alias("w")), F.struct((F.floor("rank") + 1).alias("at"), (F.col("rank") - F.floor("rank")).alias("w")))).alias("p")).select("k", "p.*").where("w > 0")
    want = want.join(cells, (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).select("k", "at", "w", "cell", "before")  # six rows on a side
    near = d.join(F.broadcast(want.select("cell").distinct()), "cell", "left_semi").groupBy("cell", "v").agg(F.count("v").alias("m"))
    near = near.withColumn("upto", F.sum("m").over(Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.broadcast(want).join(near, "cell").where((F.col("at") - F.col("before") >= F.col("upto") - F.col("m")) & (F.col("at") - F.col("before") < F.col("upto")))
    q = hit.groupBy().agg(*(F.sum(F.when(F.col("k") == k, F.col("v") * F.col("w"))).alias(f"q{k}") for k in (25, 50, 75)))
    return total.join(q).select("count", "mean", "std", "min", "q25", "q50", "q75", "max")  # one row each


#: Cells into which ``describe`` counts values before it ranks those of a few.
CELLS = 1 << 16


def _cell(v: Column) -> Column:
    """Cells in ascending order of the number: sign, exponent and leading bits of the fraction."""
    size = F.when(v == 0, F.lit(0.0)).otherwise(F.log2(F.abs(v)) * 32 + 40000)
    return (F.floor(size) * F.signum(v)).cast("int")


def best_group(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """The group with the least mean score; ties go to the least group."""
    m = df.groupBy(*group).agg(F.avg(score).alias("score"))
    return m.orderBy("score", *group).limit(1)
