"""Catalogue items: Landsat and radar scenes as structs with properties and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.sources.metadata import _text, item_sensor, landsat_fields, stripped_keys

# Asset keys and the ends of their addresses; any other key ends in ``<key>.TIF``.
SPECIAL = {"thumbnail": "thumb_small.jpeg", "reduced_resolution_browse": "thumb_large.jpeg", "ANG": "ANG.txt", "MTL.txt": "MTL.txt", "MTL.xml": "MTL.xml", "MTL.json": "MTL.json"}
QUALITY = ("QA_PIXEL", "QA_RADSAT")
REFLECTIVE = ("SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7", "SR_QA_AEROSOL")
THERMAL = ("ST_B10", "ST_ATRAN", "ST_CDIST", "ST_DRAD", "ST_EMIS", "ST_EMSD", "ST_TRAD", "ST_URAD", "ST_QA")
# Fixed values of the radar instrument.
RADAR = {"frequency_band": "C", "center_frequency": 5.405, "looks_range": 5, "looks_azimuth": 1, "pixel_spacing_range": 10}
COLLECTIONS = ("landsat-c2-l1", "landsat-c2-l2", "landsat-c2ard-st")


def assets(base: Column, keys: tuple[str, ...]) -> Column:
    """Map of key to href: ``<base>_<end>``."""
    pairs = [x for k in keys for x in (F.lit(k), F.concat(base, F.lit("_" + SPECIAL.get(k, f"{k}.TIF"))))]
    return F.create_map(*pairs)


def landsat_items(df: DataFrame, xml: str = "value", href: str = "href") -> DataFrame:
    """(id, datetime, properties, assets) of Collection 2 scenes from their MTL XML; thermal assets only for L2SP products."""
    x = F.col(xml)
    d = landsat_fields(df, xml)
    base = F.regexp_replace(F.col(href), r"_MTL\.xml$", "")
    common = (*SPECIAL, *QUALITY, *REFLECTIVE)
    all_assets = F.when(F.col("processing_level") == "L2SP", assets(base, (*common, *THERMAL))).otherwise(assets(base, common))
    s = item_sensor(F.col("item_id"))
    text = lambda c: F.col(c).cast("string")
    props = {
        "platform": F.concat(F.lit("landsat-"), s["satellite"].cast("string")),
        "instruments": s["sensor"],
        "eo:cloud_cover": F.when(F.col("cloud_cover") >= 0, text("cloud_cover")),
        "view:sun_azimuth": text("sun_azimuth"),
        "view:sun_elevation": text("sun_elevation"),
        "view:off_nadir": text("off_nadir"),
        "landsat:cloud_cover_land": _text(x, "IMAGE_ATTRIBUTES/CLOUD_COVER_LAND"),
        "landsat:wrs_type": _text(x, "IMAGE_ATTRIBUTES/WRS_TYPE"),
        "landsat:wrs_path": F.col("wrs_path"),
        "landsat:wrs_row": F.col("wrs_row"),
        "landsat:collection_category": _text(x, "PRODUCT_CONTENTS/COLLECTION_CATEGORY"),
        "landsat:collection_number": _text(x, "PRODUCT_CONTENTS/COLLECTION_NUMBER"),
        "landsat:correction": F.col("processing_level"),
        "landsat:scene_id": F.col("scene_id"),
    }
    flat = F.create_map(*(v for k, c in props.items() for v in (F.lit(k), c)))
    return d.select(F.col("item_id").alias("id"), F.col("scene_datetime").alias("datetime"), F.map_filter(flat, lambda k, v: v.isNotNull()).alias("properties"), all_assets.alias("assets"))


def legacy_properties(properties: Column) -> Column:
    """The older name of the correction level."""
    return F.transform_keys(properties, lambda k, v: F.when(k == "landsat:correction", "landsat:processing_level").otherwise(k))


def upgraded(df: DataFrame) -> DataFrame:
    """Items of the old form in the new: one off-nadir property, constellation, asset keys without endings. Without off-nadir an error."""
    p = F.col("properties")
    nadir = F.coalesce(F.try_element_at(p, F.lit("eo:off_nadir")), F.try_element_at(p, F.lit("view:off_nadir")))
    nadir = F.when(nadir.isNotNull(), nadir).otherwise(F.raise_error(F.lit("off_nadir is required")).cast("string"))
    rest = F.map_filter(p, lambda k, v: ~k.isin("eo:off_nadir", "view:off_nadir", "constellation"))
    new = F.map_concat(rest, F.create_map(F.lit("view:off_nadir"), nadir, F.lit("constellation"), F.lit("Landsat")))
    return df.withColumns({"properties": new, "assets": stripped_keys(F.col("assets"))})


def collection(name: str) -> str:
    """A known collection's id; any other is a ValueError."""
    if name not in COLLECTIONS:
        raise ValueError(f"unknown collection {name!r}")
    return name


def _named(xml: Column, name: str) -> Column:
    return F.nullif(F.xpath_string(xml, F.lit(f"//*[name()='{name}']")), F.lit(""))


def radar_fields(df: DataFrame, xml: str = "value") -> DataFrame:
    """Instrument, orbit and shape of a radar manifest or annotation; elements are found by their prefixed names."""
    x = F.col(xml)
    fixed = {f"sar_{k}": F.lit(v) for k, v in RADAR.items()}
    return df.withColumns(
        fixed
        | {
            "mode": _named(x, "s1sarl1:mode"),
            "polarisations": F.xpath(x, F.lit("//*[name()='s1sarl1:transmitterReceiverPolarisation']/text()")),
            "product_type": _named(x, "s1sarl1:productType"),
            "designator": _named(x, "safe:nssdcIdentifier"),
            "orbit_state": F.lower(_named(x, "s1:pass")),
            "absolute_orbit": _named(x, "safe:orbitNumber").try_cast("int"),
            "relative_orbit": _named(x, "safe:relativeOrbitNumber").try_cast("int"),
            "shape": F.array(_named(x, "numberOfSamples").try_cast("int"), _named(x, "numberOfLines").try_cast("int")),
            "epsg": F.lit(4326),
        }
    )


def with_geometry(items: DataFrame, stored: DataFrame, served: DataFrame, key: str = "id") -> DataFrame:
    """Geometry of each item from storage, else from the service where that has exactly one."""
    one = served.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("geometry").alias("_g")).where("_n = 1").drop("_n")
    j = items.join(stored.select(key, F.col("geometry").alias("_s")), key, "left").join(one, key, "left")
    return j.withColumn("geometry", F.coalesce("_s", "_g")).drop("_s", "_g")
