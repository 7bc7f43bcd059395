"""Small fixed dimensions: bands, resolutions, statistics, bit layouts, class codes.

All are a few dozen rows; ``table`` turns one into a DataFrame for a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (band, common name, ground sample distance in metres), in array order.
BANDS = {
    "landsat-8": [("B1", "coastal", 30), ("B2", "blue", 30), ("B3", "green", 30), ("B4", "red", 30), ("B5", "nir", 30), ("B6", "swir1", 30), ("B7", "swir2", 30), ("B8", "pan", 15), ("B9", "cirrus", 30), ("B10", "tirs1", 100), ("B11", "tirs2", 100), ("BQA", "bqa", 30)],
    "landsat-7": [("B1", "blue", 30), ("B2", "green", 30), ("B3", "red", 30), ("B4", "nir", 30), ("B5", "swir1", 30), ("B6_VCID_1", "tirs1", 60), ("B6_VCID_2", "tirs2", 60), ("B7", "swir2", 30), ("B8", "pan", 15), ("BQA", "bqa", 30)],
    "landsat-5": [("B1", "blue", 30), ("B2", "green", 30), ("B3", "red", 30), ("B4", "nir", 30), ("B5", "swir1", 30), ("B6", "tirs1", 120), ("B7", "swir2", 30), ("BQA", "bqa", 30)],
    "sentinel-2": [("B01", "coastal", 60), ("B02", "blue", 10), ("B03", "green", 10), ("B04", "red", 10), ("B05", "rededge1", 20), ("B06", "rededge2", 20), ("B07", "rededge3", 20), ("B08", "nir", 10), ("B8A", "nir08", 20), ("B09", "nir09", 60), ("B10", "cirrus", 60), ("B11", "swir1", 20), ("B12", "swir2", 20)],
    "sentinel-1": [("VV", "VV", 10), ("VH", "VH", 10)],
}
# Nominal resolution in metres.
RESOLUTION = {"sentinel-2": 10, "landsat-5": 60, "landsat-7": 30, "landsat-8": 30}
# Bands of the segmentation input, in order.
PREDICTOR_BANDS = {"sentinel-2": ["B08", "B04", "B03", "B02", "B11", "B12"], "landsat": ["nir08", "red", "green", "blue", "swir16", "swir22"]}
# First bit and number of bits in the Collection 2 pixel quality word.
QA_PIXEL = {"fill": (0, 1), "dilated_cloud": (1, 1), "cirrus": (2, 1), "cloud": (3, 1), "cloud_shadow": (4, 1), "snow": (5, 1), "clear": (6, 1), "water": (7, 1), "cloud_confidence": (8, 2), "cloud_shadow_confidence": (10, 2), "snow_confidence": (12, 2), "cirrus_confidence": (14, 2)}
QA_AEROSOL = {"fill": (0, 1), "retrieval": (1, 1), "water": (2, 1), "interpolated": (5, 1), "level": (6, 2)}
# Class codes of the decision trees.
TREE_LABELS = {"clear": 0, "water": 1, "shadow": 2, "cloud": 3, "cirrus": 4, "snow": 5}
# Sensors by the letter of an item id; radar polarisations.
SENSORS = {"M": "mss", "T": "tm", "E": "etm", "C": "oli-tirs"}
POLARISATIONS = ("vh", "hh", "hv", "vv")


def family(constellation: str) -> str:
    """The group of constellations that share band statistics: every Landsat is ``landsat``."""
    return "landsat" if constellation.startswith("landsat") else constellation


def common_names(constellation: str) -> list[str]:
    """Common names of a constellation's bands, in array order."""
    if constellation not in BANDS:
        raise ValueError(f"unknown constellation {constellation!r}")
    return [c for _, c, _ in BANDS[constellation]]


def band_info(spark: SparkSession) -> DataFrame:
    """(constellation, position, band, common_name, gsd)."""
    rows = [(c, i, *b) for c, bands in BANDS.items() for i, b in enumerate(bands)]
    return spark.createDataFrame(rows, "constellation string, position int, band string, common_name string, gsd int")


def resolutions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESOLUTION.items()), "constellation string, resolution int")
