"""Readers: tile stores, catalogues, areas, revisits, labels, service exports."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.align import modal_filter, overlapping, where_query

WATER_TS = "area_id long, date date, constellation string, area double, run_id string"
REVISITS = "aoi_id string, constellation string, time timestamp, res_level double, cloud_coverage double"


def read_tiles(spark: SparkSession, root: str, constellation: str, tile_ids: list[str] | None = None, bands: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pixels of a store partitioned by constellation and tile: partitions, dates and bands are pruned in the scan. Unknown bands are a ValueError."""
    df = spark.read.parquet(root).where(F.col("constellation") == constellation)
    if tile_ids is not None:
        df = df.where(F.col("tile_id").isin(tile_ids))
    if start or end:
        df = df.where(F.col("date").between(start or "0001-01-01", end or "2100-01-01"))
    keys = [c for c in ("constellation", "tile_id", "date", "y", "x") if c in df.columns]
    if bands is not None:
        unknown = [b for b in bands if b not in df.columns]
        if unknown:
            raise ValueError(f"unknown bands: {', '.join(unknown)}")
        df = df.select(*keys, *bands)
    return df


def revisit_slice(df: DataFrame, keys: list[str], date: str, first: int, last: int) -> DataFrame:
    """Rows of the ``first``-th to ``last``-th (exclusive) date of each key, counted from 0; only dates are ranked."""
    from pyspark.sql import Window

    d = df.select(*keys, date).distinct()
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1).where((F.col("_n") >= first) & (F.col("_n") < last)).drop("_n")
    return df.join(d, [*keys, date], "left_semi")


def tile_dates(df: DataFrame) -> DataFrame:
    return df.select("constellation", "tile_id", "date").distinct()


def search_items(items: DataFrame, collection: str, bbox: tuple[float, float, float, float], interval: tuple[str, str], query: dict | None = None, orbit_state: str = "all") -> DataFrame:
    """Catalogue items by collection, box, time and properties, in their most frequent epsg. No item is a ValueError.

    The collection's kind is told by its name: ``sentinel-s2``, ``sentinel1`` or
    ``landsat``; any other is a ValueError. ``query`` has defaults for Landsat.
    """
    name = collection.lower()
    if not any(k in name for k in ("sentinel-s2", "sentinel1", "landsat")):
        raise ValueError(f"unknown collection {collection!r}")
    d = items.where(F.col("collection") == collection).where(overlapping(bbox)).where(F.col("datetime").between(*interval))
    if "sentinel1" in name and orbit_state != "all":
        d = d.where(F.col("orbit_state") == orbit_state)
    if "landsat" in name and query is None and "collection_category" in items.columns:
        query = {"collection_category": {"in": ["T1"]}}
    d = where_query(d, query or {})
    if d.isEmpty():
        raise ValueError("no items found")
    return modal_filter(d, "epsg") if "epsg" in items.columns else d


def read_granules(spark: SparkSession, path: str) -> DataFrame:
    """Search results as CSV with a header; all columns are text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def water_list(table: DataFrame, ids: list[int]) -> DataFrame:
    """(area_id, name, geom): geometry decoded from hexadecimal WKB to binary."""
    return table.where(F.col("area_id").isin(ids)).select("area_id", "name", F.unhex("geom").alias("geom"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
def wkb_rings(geometry: pd.Series) -> pd.Series:
    """Rings of well-known binary polygons and multipolygons of either byte order; a point is a ring of one. Null stays null; anything else is an error."""

    def read(data: bytes, at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind, at = struct.unpack_from(order + "I", data, at + 1)[0], at + 5

        def points(n: int, at: int) -> tuple[list, int]:
            flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
            return [{"x": a, "y": b} for a, b in zip(flat[::2], flat[1::2], strict=True)], at + 16 * n

        if kind == 1:
            ring, at = points(1, at)
            return [ring], at
        if kind not in (3, 6):
            raise ValueError(f"not a point, polygon or multipolygon: {kind}")
        n, at = struct.unpack_from(order + "I", data, at)[0], at + 4
        rings = []
        for _ in range(n):
            if kind == 6:
                inner, at = read(data, at)
                rings += inner
            else:
                size, at = struct.unpack_from(order + "I", data, at)[0], at + 4
                ring, at = points(size, at)
                rings.append(ring)
        return rings, at

    return geometry.map(lambda g: None if g is None else read(bytes(g), 0)[0])


def read_index_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dataset_index int, timestamp string, i int, j int").csv(path, header=False)


def read_hand_labels(spark: SparkSession, path: str) -> DataFrame:
    """(tile, spacecraft_id, datetime) from one JSON object of objects."""
    entry = T.StructType([T.StructField(c, T.StringType()) for c in ("tile", "spacecraft_id", "datetime")])
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), entry))
    return text.select(F.explode(F.map_values(m)).alias("e")).select("e.*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("aoi_id long, datetime string, labels array<string>, keyed_values map<string,string>").json(path)


def seasonal(df: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str) -> DataFrame:
    """Forecast cells in a box of whole degrees; longitudes are counted from -180 in the box and from 0 in the data."""
    lo_x, lo_y, hi_x, hi_y = (round(v) for v in bbox)
    return df.where(F.col("longitude").between(lo_x + 180, hi_x + 180) & F.col("latitude").between(lo_y, hi_y) & F.col("time").between(start, end))


def nth_file(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, value): the n-th text file of a directory by name, counted from 0."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.orderBy("path").offset(n).limit(1)


def keyed_values(events: DataFrame, label: str, key: str) -> DataFrame:
    """(aoi_id, date, value) of events whose first label is ``label``: one for each area and time, the least value of repeats."""
    d = events.where(F.get("labels", F.lit(0)) == label).select("aoi_id", F.to_date(F.substring("datetime", 1, 10)).alias("date"), F.col("datetime"), F.try_element_at("keyed_values", F.lit(key)).try_cast("double").alias("value"))
    return d.groupBy("aoi_id", "datetime", "date").agg(F.min("value").alias("value")).select("aoi_id", "date", "value")
