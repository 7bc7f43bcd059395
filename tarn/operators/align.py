"""Alignment of tiles, constellations and dates, and set operations on their keys.

Dates are keys and never positions: everything the image stack aligns by index is
a join here. Large sides are never broadcast by hand; the optimiser does so where
statistics show a side to be small.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_dates(df: DataFrame, group: list[str], member: str, date: str) -> DataFrame:
    """Dates that every member of a group has: one aggregate and a semi join by key, whatever the number of members."""
    have = df.select(*group, member, date).distinct()
    size = have.groupBy(*group).agg(F.count_distinct(member).alias("_all"))
    per = have.groupBy(*group, date).agg(F.count(F.lit(1)).alias("_n"))
    return per.join(size, group).where("_n = _all").select(*group, date)


def on_common_dates(df: DataFrame, group: list[str], member: str, date: str) -> DataFrame:
    return df.join(common_dates(df, group, member, date), [*group, date], "left_semi")


def scaffold(df: DataFrame, dates: str, bands: str, key: str) -> DataFrame:
    """Every date with every band and key; where there is no value, null. Bands and keys are few by nature."""
    few = df.select(bands).distinct().crossJoin(df.select(key).distinct())
    grid = df.select(dates).distinct().crossJoin(few)
    return grid.join(df, [dates, bands, key], "left")


def to_label_dates(data: DataFrame, labels: DataFrame, on: list[str], strict: bool = True) -> DataFrame:
    """Rows of ``data`` on the dates of ``labels``; with ``strict`` a label date without data is an error."""
    if strict and not labels.select(*on).distinct().join(data, on, "left_anti").isEmpty():
        raise KeyError("label dates without data")
    return data.join(labels.select(*on), on, "left_semi")


def paired(truth: DataFrame, pred: DataFrame, on: list[str], value: str) -> DataFrame:
    """Inner join on keys; the value of each side gets a suffix."""
    return truth.select(*on, F.col(value).alias(f"{value}_true")).join(pred.select(*on, F.col(value).alias(f"{value}_pred")), on)


def left_features(base: DataFrame, other: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Left join; columns of ``other`` that clash get the suffix."""
    renamed = other.select(*on, *(F.col(c).alias(c + suffix if c in base.columns else c) for c in other.columns if c not in on))
    return base.join(renamed, on, "left")


def without(train: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    return train.join(test.select(*on), on, "left_anti")


def tile_paths(tiles: DataFrame, constellations: list[str]) -> DataFrame:
    """Each tile once for each constellation, in that order within a tile. Repeated tiles stay."""
    return tiles.withColumn("constellation", F.explode(F.array(*map(F.lit, constellations))))


def rescaled(pixels: DataFrame, constants: DataFrame, on: list[str], value: str, out: str) -> DataFrame:
    """mult * value + add by scene and band; without constants the value stays."""
    j = pixels.join(constants, on, "left")
    return j.withColumn(out, F.coalesce(F.col("mult") * F.col(value) + F.col("add"), F.col(value).cast("double"))).drop("mult", "add")


def containing(boxes: DataFrame, points: DataFrame, cell: int) -> DataFrame:
    """Pairs of a box (min_x, min_y, max_x, max_y, epsg) and a smaller one (``p_`` columns) inside it.

    The range join becomes an equality join on grid cells: a box lists the cells it
    covers, an inner box only the cell of its lower corner.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))
    outer = boxes.withColumn("_cx", F.explode(cells("min_x", "max_x"))).withColumn("_cy", F.explode(cells("min_y", "max_y")))
    inner = points.withColumn("_cx", F.floor(F.col("p_min_x") / cell).cast("long")).withColumn("_cy", F.floor(F.col("p_min_y") / cell).cast("long"))
    j = outer.join(inner, (outer["_cx"] == inner["_cx"]) & (outer["_cy"] == inner["_cy"]) & (outer["epsg"] == inner["p_epsg"]))
    return j.where((F.col("min_x") <= F.col("p_min_x")) & (F.col("min_y") <= F.col("p_min_y")) & (F.col("max_x") >= F.col("p_max_x")) & (F.col("max_y") >= F.col("p_max_y"))).drop("_cx", "_cy")


def overlapping(bbox: tuple[float, float, float, float]) -> Column:
    """Whether a row's box (min_x ...) meets ``bbox``."""
    return (F.col("min_x") <= bbox[2]) & (F.col("max_x") >= bbox[0]) & (F.col("min_y") <= bbox[3]) & (F.col("max_y") >= bbox[1])


def modal_filter(df: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """Rows with the most frequent value of a column (in their group); of equally frequent ones the least."""
    group = group or []
    n = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(*group).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("_mode"))
    joined = df.join(best, group) if group else df.crossJoin(best)  # without a group, one row
    return joined.where(F.col(column) == F.col("_mode")).drop("_mode")


def union_by_maximum(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Union of samples; where both have a key, the greater value."""
    return a.select(*keys, value).unionByName(b.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def feature_subsets(groups: list[str]) -> list[tuple[str, ...]]:
    """Every subset but the empty one, by size."""
    return [c for k in range(1, len(groups) + 1) for c in combinations(groups, k)]


def where_query(df: DataFrame, query: dict[str, dict]) -> DataFrame:
    """Property predicates ``{"column": {"in" | "eq" | "gte" | "lte" | "gt" | "lt": value}}``."""
    ops = {"in": lambda c, v: c.isin(list(v)), "eq": lambda c, v: c == v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v}
    for column, tests in query.items():
        for op, v in tests.items():
            if op not in ops:
                raise ValueError(f"unknown predicate {op!r}")
            df = df.where(ops[op](F.col(column), v))
    return df
