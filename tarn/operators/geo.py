"""Tiles, UTM zones and projection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS 84 and UTM.
A, FLAT, K0, EAST0, NORTH0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone number, with the exceptions for south-west Norway and Svalbard."""
    plain = ((lon + 180) / 6).cast("int") + 1
    svalbard = (lat >= 72) & (lat < 84)
    between = lambda a, b: (lon >= a) & (lon < b)
    return F.when((lat >= 56) & (lat < 64) & between(3, 12), 32).when(svalbard & between(0, 9), 31).when(svalbard & between(9, 21), 33).when(svalbard & between(21, 33), 35).when(svalbard & between(33, 42), 37).otherwise(plain)


def utm_epsg(lat: Column, lon: Column, zone: Column | None = None) -> Column:
    """326zz north of the equator, else 327zz; the zone has two digits."""
    z = utm_zone(lat, lon) if zone is None else zone
    return (F.when(lat > 0, 32600).otherwise(32700) + z).cast("int")


def tile_columns(df: DataFrame) -> DataFrame:
    """Add size_x, size_y, xloc, yloc and tile_id to zone, row and bounds."""
    sx, sy = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    df = df.withColumns({"size_x": sx.cast("int"), "size_y": sy.cast("int")})
    df = df.withColumns({"xloc": F.try_divide(F.col("min_x"), F.col("size_x")).cast("int"), "yloc": F.try_divide(F.col("min_y"), F.col("size_y")).cast("int")})
    return df.withColumn("tile_id", F.concat_ws("_", "zone", "row", "size_x", "xloc", "yloc"))


def tile_from_id(df: DataFrame, column: str = "tile_id") -> DataFrame:
    """Bounds and epsg from ids ``zone_row_size_x_y``; an id without five parts is an error."""
    p = F.split(F.col(column), "_")
    ok = F.size(p) == 5
    part = lambda i: F.when(ok, p[i]).otherwise(F.raise_error(F.concat(F.lit("not a tile id: "), F.col(column))).cast("string"))
    size = part(2).cast("long")
    d = df.withColumns({"zone": part(0).cast("int"), "row": part(1), "min_x": part(3).cast("long") * size, "min_y": part(4).cast("long") * size})
    return d.withColumns({"max_x": F.col("min_x") + size, "max_y": F.col("min_y") + size, "epsg": (F.when(F.col("row") < "N", 32700).otherwise(32600) + F.col("zone")).cast("int")})


def bounding_box(points: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def ring_area(ring: Column) -> Column:
    """Area inside a closed ring of (x, y): half the sum of cross products along its edges."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, v: s + v)) / 2


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Krueger's series to the sixth order of the third flattening."""
    n = FLAT / (2 - FLAT)
    a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return a, alpha, beta, delta


def to_utm(lat: np.ndarray, lon: np.ndarray, zone: np.ndarray, south: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in metres, good to about a millimetre within a zone."""
    a, alpha, _, _ = _series()
    e = math.sqrt(FLAT * (2 - FLAT))
    phi, lam = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    x, y = eta.copy(), xi.copy()
    for j, c in enumerate(alpha, 1):
        x += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return EAST0 + K0 * a * x, np.where(south, NORTH0, 0.0) + K0 * a * y


def from_utm(x: np.ndarray, y: np.ndarray, zone: np.ndarray, south: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees."""
    a, _, beta, delta = _series()
    xi, eta = (y - np.where(south, NORTH0, 0.0)) / (K0 * a), (x - EAST0) / (K0 * a)
    xp, ep = xi.copy(), eta.copy()
    for j, c in enumerate(beta, 1):
        xp -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        ep -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(xp) / np.cosh(ep))
    phi = chi.copy()
    for j, c in enumerate(delta, 1):
        phi += c * np.sin(2 * j * chi)
    return np.degrees(phi), np.degrees(np.arctan2(np.sinh(ep), np.cos(xp))) + zone * 6 - 183


def _pair(a: str, b: str) -> T.StructType:
    return T.StructType([T.StructField(a, T.DoubleType()), T.StructField(b, T.DoubleType())])


@F.pandas_udf(_pair("x", "y"))
def utm_xy(lat: pd.Series, lon: pd.Series, zone: pd.Series, south: pd.Series) -> pd.DataFrame:
    x, y = to_utm(lat.to_numpy(float), lon.to_numpy(float), zone.to_numpy(float), south.to_numpy(bool))
    return pd.DataFrame({"x": x, "y": y})


@F.pandas_udf(_pair("lat", "lon"))
def utm_lonlat(x: pd.Series, y: pd.Series, zone: pd.Series, south: pd.Series) -> pd.DataFrame:
    lat, lon = from_utm(x.to_numpy(float), y.to_numpy(float), zone.to_numpy(float), south.to_numpy(bool))
    return pd.DataFrame({"lat": lat, "lon": lon})


ROWS = "CDEFGHJKLMNPQRSTUVWX"


def tiles_of_boxes(df: DataFrame, size: int = 10000, key: str = "area_id") -> DataFrame:
    """(key, zone, row, bounds, epsg) of the UTM tiles that meet each longitude/latitude box, in the zone of its centre."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                lat, lon = (r.min_y + r.max_y) / 2, (r.min_x + r.max_x) / 2
                zone, south = int((lon + 180) // 6) + 1, lat <= 0
                edge = np.linspace(0, 1, 17)
                lons = np.r_[r.min_x + edge * (r.max_x - r.min_x), np.full(17, r.max_x), r.min_x + edge * (r.max_x - r.min_x), np.full(17, r.min_x)]
                lats = np.r_[np.full(17, r.min_y), r.min_y + edge * (r.max_y - r.min_y), np.full(17, r.max_y), r.min_y + edge * (r.max_y - r.min_y)]
                x, y = to_utm(lats, lons, np.full(68, float(zone)), np.full(68, south))
                row = ROWS[min(max(int((lat + 80) // 8), 0), 19)]
                for i in range(int(x.min() // size), int(x.max() // size) + 1):
                    for j in range(int(y.min() // size), int(y.max() // size) + 1):
                        out.append((getattr(r, key), zone, row, i * size, j * size, (i + 1) * size, (j + 1) * size, (32700 if south else 32600) + zone))
            yield pd.DataFrame(out, columns=[key, "zone", "row", "min_x", "min_y", "max_x", "max_y", "epsg"])

    kind = df.schema[key].simpleString().split(":", 1)[1]
    return df.select(key, "min_x", "min_y", "max_x", "max_y").mapInPandas(run, f"`{key}` {kind}, zone int, row string, min_x long, min_y long, max_x long, max_y long, epsg int")


def proj_bbox(xs: Column, ys: Column, gsd: Column) -> Column:
    """Bounds of corner pixel centres widened by half a pixel."""
    h = gsd / 2
    return F.struct((F.array_min(xs) - h).alias("min_x"), (F.array_min(ys) - h).alias("min_y"), (F.array_max(xs) + h).alias("max_x"), (F.array_max(ys) + h).alias("max_y"))


def landsat_epsg(zone: Column, centre_lat: Column, satellite: Column, true_scale_lat: Column) -> Column:
    """UTM by zone (Landsat 8: south by centre latitude); polar stereographic at +-71; else an error."""
    utm = F.when((satellite == 8) & (centre_lat < 0), 32700 + zone).otherwise(32600 + zone)
    return F.when(zone.isNotNull(), utm).when(true_scale_lat == -71, 3031).when(true_scale_lat == 71, 3995).otherwise(F.raise_error(F.lit("no epsg")).cast("int")).cast("int")


def unwrapped(lons: Column) -> Column:
    """Longitudes over 180 brought back by 360."""
    return F.transform(lons, lambda v: F.when(v > 180, v - 360).otherwise(v))


def tile_rings(tiles: DataFrame) -> DataFrame:
    """Add ``ring``: the closed (lon, lat) outline of each tile's corners."""
    south = F.col("epsg") >= 32700
    corner = lambda x, y: utm_lonlat(F.col(x).cast("double"), F.col(y).cast("double"), F.col("zone").cast("double"), south)
    names = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")]
    d = tiles.withColumns({f"_c{i}": corner(*c) for i, c in enumerate(names)})
    points = [F.struct(F.col(f"_c{i}.lon").alias("lon"), F.col(f"_c{i}.lat").alias("lat")) for i in (0, 1, 2, 3, 0)]
    return d.withColumn("ring", F.array(*points)).drop(*(f"_c{i}" for i in range(4)))
