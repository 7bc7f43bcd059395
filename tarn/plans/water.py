"""End-to-end plans: served area series, and imagery to area series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import frames, geo, rules, timeseries
from tarn.sources import sinks


def area_points(water_ts: DataFrame, area_id: int | list[int] | None = None, constellation: str = "all") -> DataFrame:
    """(area_id, date, constellation, area): positive areas of the latest run. Filters reach the scan."""
    d = water_ts.where("area > 0")
    if area_id is not None:
        d = d.where(F.col("area_id").isin(area_id if isinstance(area_id, list) else [area_id]))
    if constellation != "all":
        d = d.where(F.col("constellation") == constellation)
    return timeseries.latest_run(d, ["area_id", "date", "constellation"])


def of_model(water_ts: DataFrame, model: str) -> DataFrame:
    """Rows of the runs of one model, whose ids hold its name between hyphens: ``%-<model>-%``. The predicate reaches the scan."""
    name = model.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return water_ts.where(F.col("run_id").like(f"%-{name}-%"))


def resampled(points: DataFrame, days: int = 30) -> DataFrame:
    """Whole mean areas in bins of ``days`` days from each series' first date; empty bins are 0."""
    return timeseries.resample(points, ["area_id", "constellation"], "date", "area", days)


def timeseries_response(water_ts: DataFrame, area_id: int, constellation: str = "all", resample: bool = True) -> DataFrame:
    """One row for the area: a map from constellation to its points. No row where the area is unknown."""
    p = area_points(water_ts, area_id, constellation)
    return sinks.series_by_key(resampled(p) if resample else p, ["area_id"])


def area_series(pixels: DataFrame, constellation: str, resolution: float, polygons=None, burn: str | None = None, limit: int = 50) -> DataFrame:
    """(area_id, constellation, date, area): classify pixels map-side, clean each frame, sum the area that touches the burned outline.

    ``pixels`` has area_id, date, y, x, the constellation's bands and the outline
    raster ``burn``. One shuffle: by frame.
    """
    classified = rules.classify_water(pixels, constellation, polygons)
    slim = classified.select("area_id", "date", "y", "x", "mask", *([burn] if burn else []))
    a = frames.cleaned_area(slim, ["area_id", "date"], "mask", burn, 1, limit, resolution)
    return a.select("area_id", F.lit(constellation).alias("constellation"), "date", "area")


def all_constellations(parts: list[DataFrame]) -> DataFrame:
    """Union of the series of the constellations; none at all is an AssertionError."""
    if not parts:
        raise AssertionError("no constellation has masks")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup(dim: DataFrame, key: str, value=None) -> DataFrame:
    """All rows of a dimension, or those of one key; the filter reaches the scan."""
    return dim if value is None else dim.where(F.col(key) == value)


def tile_geometries(water_tiles: DataFrame, area_id: int) -> DataFrame:
    """(tile_id, ring) of the tiles of one area from (area_id, tiles)."""
    ids = water_tiles.where(F.col("area_id") == area_id).select(F.explode("tiles").alias("tile_id"))
    return geo.tile_rings(geo.tile_from_id(ids)).select("tile_id", "ring")
