"""Complete scene items: properties, projection, links and described assets.

The assets of a sensor come from a small table of definitions, read from JSON
documents (``read_definitions``), so that sensors and bands are data and not code;
``legacy_items`` has the older Landsat 8 form, whose definitions are fixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.geo import landsat_epsg
from tarn.sources.items import RADAR, collection, radar_fields
from tarn.sources.metadata import _number, _text, asset_key, band_of_image, item_sensor, landsat_fields, mid_time, safe_footprint

# Instruments, reflective and thermal ground sample distance in metres, and the data set's identifier and title, by sensor.
INSTRUMENTS = {
    "mss": (["mss"], 79, None, "10.5066/P9AF14YV", "Landsat 1-5 MSS Collection 2 Level-1"),
    "tm": (["tm"], 30, 120, "10.5066/P9IAXOVV", "Landsat 4-5 TM Collection 2 Level-2"),
    "etm": (["etm+"], 30, 60, "10.5066/P9C7I13B", "Landsat 7 ETM+ Collection 2 Level-2"),
    "oli-tirs": (["oli", "tirs"], 30, 100, "10.5066/P9OGBGM6", "Landsat 8-9 OLI/TIRS Collection 2 Level-2"),
}
# The public services that items link to.
STAC_SERVER = "https://landsatlook.usgs.gov/stac-server"
STAC_BROWSER = "https://landsatlook.usgs.gov/stac-browser/collection02"
RADAR_LICENSE = "https://sentinel.esa.int/documents/247904/690755/Sentinel_Data_Legal_Notice"
# Fixed values: (key, title, group) of the older Landsat 8 assets, in order.
LEGACY_ASSETS = [
    ("thumbnail", "Thumbnail image", "file"),
    ("reduced_resolution_browse", "Reduced resolution browse image", "file"),
    ("ANG", "Angle Coefficients File", "file"),
    ("MTL.txt", "Product Metadata File", "file"),
    ("MTL.xml", "Product Metadata File (xml)", "file"),
    ("MTL.json", "Product Metadata File (json)", "file"),
    ("QA_PIXEL", "Pixel Quality Assessment Band", "sr"),
    ("QA_RADSAT", "Radiometric Saturation Quality Assessment Band", "sr"),
    ("SR_B1", "Coastal/Aerosol Band (B1)", "sr"),
    ("SR_B2", "Blue Band (B2)", "sr"),
    ("SR_B3", "Green Band (B3)", "sr"),
    ("SR_B4", "Red Band (B4)", "sr"),
    ("SR_B5", "Near Infrared Band 0.8 (B5)", "sr"),
    ("SR_B6", "Short-wave Infrared Band 1.6 (B6)", "sr"),
    ("SR_B7", "Short-wave Infrared Band 2.2 (B7)", "sr"),
    ("SR_QA_AEROSOL", "Aerosol Quality Analysis Band", "sr"),
    ("ST_B10", "Surface Temperature Band (B10)", "st"),
    ("ST_ATRAN", "Atmospheric Transmittance Band", "st"),
    ("ST_CDIST", "Cloud Distance Band", "st"),
    ("ST_DRAD", "Downwelled Radiance Band", "st"),
    ("ST_URAD", "Upwelled Radiance Band", "st"),
    ("ST_TRAD", "Thermal Radiance Band", "st"),
    ("ST_EMIS", "Emissivity Band", "st"),
    ("ST_EMSD", "Emissivity Standard Deviation Band", "st"),
    ("ST_QA", "Surface Temperature Quality Assessment Band", "st"),
]
# Media types and ends of address of the assets that are no images.
LEGACY_FILES = {"thumbnail": ("image/jpeg", "thumb_small.jpeg"), "reduced_resolution_browse": ("image/jpeg", "thumb_large.jpeg"), "ANG": ("text/plain", "ANG.txt"), "MTL.txt": ("text/plain", "MTL.txt"), "MTL.xml": ("application/xml", "MTL.xml"), "MTL.json": ("application/json", "MTL.json")}
COG = "image/tiff; application=geotiff; profile=cloud-optimized"
# Common name, centre wavelength and full width at half maximum in micrometres.
LEGACY_BANDS = {
    "SR_B1": ("coastal", 0.44, 0.02),
    "SR_B2": ("blue", 0.48, 0.06),
    "SR_B3": ("green", 0.56, 0.06),
    "SR_B4": ("red", 0.65, 0.04),
    "SR_B5": ("nir08", 0.86, 0.03),
    "SR_B6": ("swir16", 1.6, 0.08),
    "SR_B7": ("swir22", 2.2, 0.2),
    "ST_B10": ("lwir11", 10.9, 0.8),
}
#: Resolution at the sensor where that is not the raster's.
LEGACY_GSD = {"ST_B10": 100.0}

BAND = "name string, common_name string, description string, center_wavelength double, full_width_half_max double"
RASTER = "temp_name string, data_type string, nodata string, unit string, scale double, offset double, spatial_resolution double"
ASSET = "title string, description string, type string, roles array<string>, href_suffix string"
DEFINITION = f"sensor string, part string, position int, key string, asset struct<{ASSET}>, band struct<{BAND}>, raster struct<{RASTER}>"
#: Media types by the names that definitions use.
MEDIA = {"JPEG": "image/jpeg", "PNG": "image/png", "JSON": "application/json", "TEXT": "text/plain", "XML": "application/xml", "GEOTIFF": "image/tiff; application=geotiff", "COG": COG}


def read_definitions(spark: SparkSession, root: str) -> DataFrame:
    """Definitions (``DEFINITION``) from ``<root>/<sensor>/<part>-<kind>.json``: objects by asset key.

    ``part`` is ``common``, ``sr`` or ``st``; ``kind`` is ``assets``, ``eo-bands`` or
    ``raster-bands``. The sensor ``common`` stands for every sensor.
    """
    kinds = {"assets": ASSET, "eo-bands": BAND, "raster-bands": RASTER}
    docs = spark.read.text(f"{root}/*/*.json", wholetext=True).select("value", F.split("_metadata.file_path", "/").alias("p"))
    name = F.regexp_extract(F.element_at("p", -1), r"^([a-z]+)-(.+)\.json$", 2)
    docs = docs.select("value", F.replace(F.element_at("p", -2), F.lit("_"), F.lit("-")).alias("sensor"), F.regexp_extract(F.element_at("p", -1), r"^([a-z]+)-", 1).alias("part"), name.alias("kind"))
    parts = {}
    for kind, schema in kinds.items():
        entries = F.map_entries(F.from_json("value", f"map<string, struct<{schema}>>"))
        parts[kind] = docs.where(F.col("kind") == kind).select("sensor", "part", F.posexplode(entries).alias("position", "e")).select("sensor", "part", "position", F.col("e.key").alias("key"), F.col("e.value").alias(kind))
    on = ["sensor", "part", "key"]
    out = parts["assets"].join(parts["eo-bands"].drop("position"), on, "left").join(parts["raster-bands"].drop("position"), on, "left")
    sensor = F.explode(F.when(F.col("sensor") == "common", F.array(*map(F.lit, INSTRUMENTS))).otherwise(F.array("sensor")))
    return out.select(sensor.alias("sensor"), "part", "position", "key", F.col("assets").alias("asset"), F.col("eo-bands").alias("band"), F.col("raster-bands").alias("raster"))


LINK = "rel string, href string, title string, type string"
#: Extent, summaries and providers stay JSON, as their fields differ between collections.
COLLECTION = f"title string, description string, license string, keywords array<string>, providers string, extent string, summaries string, links array<struct<{LINK}>>, item_assets map<string, struct<{ASSET}>>"


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One row: the known collection ``name`` from ``<root>/<name>.json``; any other name is a ValueError. Media types by their full names."""
    d = spark.read.schema(COLLECTION).json(f"{root}/{collection(name)}.json", multiLine=True)
    types = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    typed = F.transform_values("item_assets", lambda k, v: v.withField("type", F.coalesce(F.try_element_at(types, F.coalesce(v["type"], F.lit(""))), v["type"])))
    return d.select(F.lit(name).alias("id"), *(c for c in d.columns if c != "item_assets"), typed.alias("item_assets"))


def radiance(xml: Column, bands: tuple[str, ...] = tuple(map(str, range(1, 12)))) -> Column:
    """Map of band to struct(mult, add); without either the band is left out."""
    at = "LEVEL1_RADIOMETRIC_RESCALING/RADIANCE_{}_BAND_{}"
    rows = F.array(*(F.struct(F.lit(f"B{b}").alias("band"), F.struct(_number(xml, at.format("MULT", b)).alias("mult"), _number(xml, at.format("ADD", b)).alias("add")).alias("c")) for b in bands))
    return F.map_from_entries(F.filter(rows, lambda r: r["c"]["mult"].isNotNull() & r["c"]["add"].isNotNull()))


def _older(early: Column, c: Column) -> Column:
    """Texts of the first three satellites' scanner: its bands are numbered from 4."""
    shifted = reduce(lambda t, n: F.replace(t, F.lit(f"B{n}"), F.lit(f"B{n + 3}")), (4, 3, 2, 1), c)
    return F.when(early, F.replace(shifted, F.lit("4-5"), F.lit("1-3"))).otherwise(c)


def _placed(df: DataFrame, xml: str) -> DataFrame:
    """Add bbox [min_lon, min_lat, max_lon, max_lat], epsg and thermal_transform to the scene's fields."""
    x = F.col(xml)
    corners = lambda axis: F.array(*(_number(x, f"PROJECTION_ATTRIBUTES/CORNER_{c}_{axis}_PRODUCT") for c in ("UL", "UR", "LL", "LR")))
    lon, lat, b, shape = corners("LON"), corners("LAT"), F.col("proj_bbox"), F.col("thermal_shape")
    bbox = F.array(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat))
    epsg = landsat_epsg(F.col("utm_zone"), (F.array_min(lat) + F.array_max(lat)) / 2, F.col("satellite"), _number(x, "PROJECTION_ATTRIBUTES/TRUE_SCALE_LAT"))
    thermal = F.array((b[2] - b[0]) / shape[1], F.lit(0.0), b[0], F.lit(0.0), (b[1] - b[3]) / shape[0], b[3])
    return df.withColumns({"bbox": bbox, "epsg": epsg, "thermal_transform": F.when(shape.isNotNull(), thermal)})


def _landsat(xml: str) -> Column:
    """The properties that both forms of items have."""
    x, p = F.col(xml), "IMAGE_ATTRIBUTES/"
    kept = {"cloud_cover_land": _text(x, p + "CLOUD_COVER_LAND"), "wrs_type": _text(x, p + "WRS_TYPE"), "wrs_path": F.col("wrs_path"), "wrs_row": F.col("wrs_row"), "collection_category": _text(x, "PRODUCT_CONTENTS/COLLECTION_CATEGORY"), "collection_number": _text(x, "PRODUCT_CONTENTS/COLLECTION_NUMBER"), "correction": F.col("processing_level"), "scene_id": F.col("scene_id")}
    return F.map_filter(F.create_map(*(v for k, c in kept.items() for v in (F.lit(f"landsat:{k}"), c))), lambda k, v: v.isNotNull())


def scene_items(df: DataFrame, definitions: DataFrame, xml: str = "value", href: str = "href", server: str = STAC_SERVER) -> DataFrame:
    """Items of Collection 2 scenes of any Landsat from their MTL XML, with the assets that ``definitions`` has for the sensor.

    Thermal assets only for L2SP; the multispectral scanner has no angle file, and
    its bands take scale and offset from the document, or no unit without them. Cloud
    cover is null where it is unknown. ``definitions`` has some dozens of rows for a sensor.
    """
    by = definitions.groupBy(F.col("sensor").alias("_of")).agg(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, ("common", "sr", "st"))), F.col("part")).alias("o"), "position", "part", "key", "asset", "band", "raster"))).alias("_defs"))
    d = _placed(landsat_fields(df, xml), xml).withColumns({"_s": item_sensor(F.col("item_id")), "_rad": radiance(F.col(xml)), "_base": F.regexp_replace(F.col(href), r"_[^_]*$", "")})
    d = d.join(by, F.col("_s.sensor") == F.col("_of"), "left")
    sensor, level, scanner = F.col("_s.sensor"), F.col("_s.level"), F.col("_s.sensor") == "mss"
    early = scanner & (F.col("satellite") < 4)
    of = lambda i: reduce(lambda c, k: c.when(sensor == k, F.lit(INSTRUMENTS[k][i])), list(INSTRUMENTS)[1:], F.when(sensor == "mss", F.lit(INSTRUMENTS["mss"][i])))

    def described(a: Column) -> Column:
        asset, band, raster = a["asset"], a["band"], a["raster"]
        media = reduce(lambda c, m: c.when(asset["type"] == m, MEDIA[m]), list(MEDIA)[1:], F.when(asset["type"] == "JPEG", MEDIA["JPEG"])).otherwise(COG)
        end = F.coalesce(asset["href_suffix"], F.concat(F.upper(a["key"]), F.lit(".TIF")))
        text = F.when(a["key"].startswith("mtl"), F.replace(asset["description"], F.lit("Level-X"), F.concat(F.lit("Level-"), level))).otherwise(asset["description"])
        source = _older(early, raster["temp_name"])
        c = F.try_element_at(F.col("_rad"), F.coalesce(source, F.lit("")))
        known, own = c.isNotNull() & (c["mult"] != 0) & (c["add"] != 0), source.isNull()
        value = F.struct(raster["data_type"].alias("data_type"), raster["nodata"].alias("nodata"), F.when(own | known, raster["unit"]).alias("unit"), F.when(own, raster["scale"]).when(known, c["mult"]).alias("scale"), F.when(own, raster["offset"]).when(known, c["add"]).alias("offset"), raster["spatial_resolution"].alias("spatial_resolution"))
        optics = F.struct(_older(early, band["name"]).alias("name"), band["common_name"].alias("common_name"), band["description"].alias("description"), band["center_wavelength"].alias("center_wavelength"), band["full_width_half_max"].alias("full_width_half_max"))
        thermal = (a["part"] == "st") & a["key"].startswith("lwir")
        return F.struct(
            a["key"].alias("key"),
            F.struct(F.concat(F.col("_base"), F.lit("_"), _older(early, end)).alias("href"), media.alias("type"), _older(early, asset["title"]).alias("title"), _older(early, text).alias("description"), asset["roles"].alias("roles"), F.when(thermal, of(2)).alias("gsd"), F.when(band.isNotNull(), optics).alias("band"), F.when(raster.isNotNull(), value).alias("raster")).alias("value"),
        )

    wanted = F.filter("_defs", lambda a: ((a["part"] != "st") | (F.col("processing_level") == "L2SP")) & ~(scanner & a["key"].startswith("ang")))
    link = lambda c, end="": F.concat(F.lit(f"{server}/collections/{c}/items/"), F.col("product_id"), F.lit(end))
    sr, st = link("landsat-c2l2-sr", "_SR"), link("landsat-c2l2-st", "_ST")
    correction = F.col("_s.correction")
    via = F.when(level == "1", F.array(link("landsat-c2l1"))).when((level == "2") & (correction == "SP"), F.array(sr, st)).when((level == "2") & (correction == "SR"), F.array(sr)).otherwise(F.array().cast("array<string>"))
    return d.select(
        F.col("item_id").alias("id"), F.col("scene_datetime").alias("datetime"), "bbox",
        F.concat(F.lit("landsat-"), F.col("satellite").cast("string")).alias("platform"), of(0).alias("instruments"), of(1).alias("gsd"),
        F.concat(F.lit("Landsat Collection 2 Level-"), level).alias("description"),
        F.when(F.col("cloud_cover") >= 0, F.col("cloud_cover")).alias("cloud_cover"), "off_nadir", "sun_elevation", "sun_azimuth",
        "epsg", F.col("sr_shape").alias("proj_shape"), F.col("sr_transform").alias("proj_transform"), _landsat(xml).alias("properties"),
        of(3).alias("doi"), of(4).alias("doi_title"), via.alias("via"), F.map_from_entries(F.transform(wanted, described)).alias("assets"),
    )


def legacy_items(df: DataFrame, xml: str = "value", href: str = "href", legacy: bool = False) -> DataFrame:
    """Landsat 8 items of the older form. Off-nadir is 0 or unknown; images have their own distance, shape and transform.

    ``legacy`` links to the page by item id, as those items do; there is none under it,
    so that by default the product id is used.
    """
    d = _placed(landsat_fields(df, xml), xml).withColumn("_base", F.regexp_replace(F.col(href), r"_[^_]*$", ""))
    band = lambda k: F.struct(F.lit(k).alias("name"), *(F.lit(v).alias(n) for n, v in zip(("common_name", "center_wavelength", "full_width_half_max"), LEGACY_BANDS[k], strict=True)))
    empty = F.lit(None).cast("struct<name string, common_name string, center_wavelength double, full_width_half_max double>")
    image = {"file": (None, None, None), "sr": ("sr_gsd", "sr_shape", "sr_transform"), "st": ("thermal_gsd", "thermal_shape", "thermal_transform")}
    kinds = ("double", "array<int>", "array<double>")

    def entry(key: str, title: str, group: str) -> Column:
        media, end = LEGACY_FILES.get(key, (COG, f"{key}.TIF"))
        gsd, shape, transform = (F.lit(None).cast(t) if c is None else F.col(c) for c, t in zip(image[group], kinds, strict=True))
        gsd = F.lit(LEGACY_GSD[key]) if key in LEGACY_GSD else gsd
        return F.struct(F.lit(key).alias("key"), F.struct(F.concat(F.col("_base"), F.lit(f"_{end}")).alias("href"), F.lit(media).alias("type"), F.lit(title).alias("title"), gsd.alias("gsd"), (band(key) if key in LEGACY_BANDS else empty).alias("band"), shape.alias("proj_shape"), transform.alias("proj_transform")).alias("value"))

    common = F.array(*(entry(*a) for a in LEGACY_ASSETS if a[2] != "st"))
    thermal = F.array(*(entry(*a) for a in LEGACY_ASSETS if a[2] == "st"))
    entries = F.when(F.col("processing_level") == "L2SP", F.concat(common, thermal)).otherwise(common)
    page = F.concat_ws("/", F.lit(f"{STAC_BROWSER}/level-2/standard/oli-tirs"), F.year("scene_datetime"), "wrs_path", "wrs_row", "item_id" if legacy else "product_id")
    properties = F.transform_keys(_landsat(xml), lambda k, v: F.when(k == "landsat:correction", "landsat:processing_level").otherwise(k))
    return d.select(
        F.col("item_id").alias("id"), F.col("scene_datetime").alias("datetime"), "bbox", F.lit("landsat-8").alias("platform"), F.array(F.lit("oli"), F.lit("tirs")).alias("instruments"),
        F.lit("Landsat Collection 2 Level-2 Surface Reflectance Product").alias("description"), "cloud_cover", F.when(_text(F.col(xml), "IMAGE_ATTRIBUTES/NADIR_OFFNADIR") == "NADIR", F.lit(0.0)).alias("off_nadir"), "sun_elevation", "sun_azimuth",
        "epsg", "proj_bbox", properties.alias("properties"), page.alias("alternate"), F.map_from_entries(entries).alias("assets"),
    )


def radar_items(df: DataFrame, xml: str = "value", annotation: str = "annotation", href: str = "href", files: str = "files") -> DataFrame:
    """Items of radar granules from their manifest, one annotation document and the paths of their files.

    Assets are the manifest, the product, calibration and noise documents, the
    preview and the images, by polarisation. Two images of one key are an error.
    """
    name = lambda n: F.nullif(F.xpath_string(F.col(xml), F.lit(f"//*[name()='{n}']")), F.lit(""))
    d = radar_fields(df, xml)
    granule = F.regexp_replace(F.col(href), r"/[^/]*$", "")
    ring = safe_footprint(name("gml:coordinates"))
    axis = lambda c: F.transform(F.col("geometry"), lambda p: p[c])
    asset = lambda key, path, kind, title, role: F.struct(key.alias("key"), F.struct(path.alias("href"), F.lit(kind).alias("type"), title.cast("string").alias("title"), F.array(F.lit(role)).alias("roles")).alias("value"))
    under = lambda pattern: F.filter(files, lambda f: f.rlike(pattern))

    def documents(kind: str, pattern: str) -> Column:
        def key(f: Column) -> Column:
            stem = F.regexp_extract(f, r"([^/.]+)\.[^/]*$", 1)
            short = F.when(stem.startswith(f"{kind}-"), stem).otherwise(F.concat(F.lit(f"{kind}-"), stem))
            return F.when(F.size(F.split(stem, "-")) > 3, asset_key(f, kind)).otherwise(short)

        return F.transform(under(pattern), lambda f: asset(key(f), f, MEDIA["XML"], F.lit(f"{kind.capitalize()} Schema"), "metadata"))

    image = lambda f: band_of_image(F.element_at(F.split(f, "/"), -1))
    entries = F.concat(
        F.array(asset(F.lit("safe-manifest"), F.col(href), MEDIA["XML"], F.lit(None), "metadata")),
        documents("product", r"/annotation/[^/]*\.xml$"),
        documents("calibration", r"/annotation/calibration/[^/]*calibration[^/]*\.xml$"),
        documents("noise", r"/annotation/calibration/[^/]*noise[^/]*\.xml$"),
        F.array(asset(F.lit("thumbnail"), F.concat(granule, F.lit("/preview/quick-look.png")), MEDIA["PNG"], F.lit(None), "thumbnail")),
        F.transform(under(r"/measurement/[^/]*\.tiff$"), lambda f: asset(image(f), f, MEDIA["GEOTIFF"], F.concat(F.upper(image(f)), F.lit(" - 10m")), "data")),
    )
    size = lambda n: F.xpath_string(F.col(annotation), F.lit(f"//*[name()='{n}']")).try_cast("int")
    start, stop = (F.try_to_timestamp(name(f"safe:{n}Time"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")) for n in ("start", "stop"))
    d = d.withColumns({"geometry": ring, "start_datetime": start, "end_datetime": stop})
    properties = F.create_map(F.lit("s1:instrument_configuration_ID"), name("s1sarl1:instrumentConfigurationID"), F.lit("s1:datatake_id"), name("s1sarl1:missionDataTakeID"))
    return d.select(
        F.regexp_extract(F.col(href), r"([^/.]+)[^/]*/[^/]*$", 1).alias("id"), mid_time(F.col("start_datetime"), F.col("end_datetime")).alias("datetime"), "start_datetime", "end_datetime", "geometry",
        F.array(F.array_min(axis("lon")), F.array_min(axis("lat")), F.array_max(axis("lon")), F.array_max(axis("lat"))).alias("bbox"),
        F.concat(name("safe:familyName"), name("safe:number")).alias("platform"), F.lit("Sentinel 1").alias("constellation"), *(f"sar_{k}" for k in RADAR), "mode", "polarisations", "product_type", "designator", "orbit_state", "absolute_orbit", "relative_orbit", "epsg",
        F.array(size("numberOfSamples"), size("numberOfLines")).alias("proj_shape"), F.map_filter(properties, lambda k, v: v.isNotNull()).alias("properties"), F.lit(RADAR_LICENSE).alias("license"), F.map_from_entries(entries).alias("assets"),
    )
