"""Scene metadata: MTL text, MTL and SAFE XML, angle files, product names, item derivation."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MtlError(Exception):
    """Text that is not well-formed metadata."""


_ITEM = re.compile(r"^\s*(?P<key>[A-Z_]+)? = (?P<value>.*)$")


def parse_mtl(text: str) -> dict:
    """Nested groups of typed values from ``GROUP = X`` / ``KEY = value`` / ``END_GROUP = X`` / ``END`` lines.

    Outside any group only a group or END may follow; a group must be closed by
    its own name; END must come with all groups closed; nothing follows it.
    """
    root: dict = {}
    stack: list[tuple[str, dict]] = []
    state, ended = "begin", False
    for raw in text.splitlines():
        line = raw.strip()
        if ended:
            break
        if line.startswith("GROUP = ") and state != "item":
            name = line[len("GROUP = ") :]
            inner: dict = {}
            (stack[-1][1] if stack else root)[name] = inner
            stack.append((name, inner))
            state = "group"
        elif line.startswith("END_GROUP = ") and state != "begin":
            name = line[len("END_GROUP = ") :]
            if not stack or stack[-1][0] != name:
                raise MtlError(f"{line!r} does not close {stack[-1][0] if stack else None!r}")
            stack.pop()
            state = "closed"
        elif line == "END" and state in ("begin", "closed"):
            if stack:
                raise MtlError(f"end inside group {stack[-1][0]!r}")
            ended = True
        elif " = " in line and state in ("group", "item"):
            key, value = line.split(" = ")[:2]
            if key == "SCENE_CENTER_TIME":
                value = value.strip('"')
            stack[-1][1][key] = typed(value)
            state = "item"
        else:
            raise MtlError(f"cannot follow {state}: {line!r}")
    return root


def typed(value: str):
    """Quoted text, integer, float, date, date and time, time of day, else the text itself."""
    if len(value) > 1 and value[0] == value[-1] == '"':
        return value[1:-1]
    if re.fullmatch(r"-?\d+", value):
        return int(value)
    if re.fullmatch(r"-?\d+\.\d+(E[+-]?\d\d+)?", value):
        return float(value)
    for form, part in (("%Y-%m-%d", dt.datetime.date), ("%Y-%m-%dT%H:%M:%SZ", lambda d: d)):
        try:
            return part(dt.datetime.strptime(value, form))
        except ValueError:
            pass
    m = re.match(r"\d{2}:\d{2}:\d{2}\.\d{6}", value)
    if m:
        try:
            return dt.datetime.strptime(m[0], "%H:%M:%S.%f").time()
        except ValueError:
            pass
    return value


def mtl_items(df: DataFrame, text: str = "value", keys: list[str] | None = None) -> DataFrame:
    """(keys, path, key, value, kind) of every item of whole MTL texts: ``path`` joins group names with ``/``, ``kind`` is the Python type."""
    keys = keys or []
    ddl = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "path string, key string, value string, kind string"

    def walk(d: dict, path: str) -> Iterator[tuple]:
        for k, v in d.items():
            if isinstance(v, dict):
                yield from walk(v, f"{path}/{k}" if path else k)
            else:
                yield path, k, str(v), type(v).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(*(b.column(i)[r].as_py() for i in range(len(keys))), *item) for r in range(b.num_rows) for item in walk(parse_mtl(b.column(len(keys))[r].as_py() or "END"), "")]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], b.schema.field(i).type) for i in range(n)), *(pa.array([o[n + i] for o in out], pa.string()) for i in range(4))], names=[*keys, "path", "key", "value", "kind"])

    return df.select(*keys, text).mapInArrow(run, ddl)


_ROOT = "/LANDSAT_METADATA_FILE"


def _text(xml: Column, path: str) -> Column:
    return F.nullif(F.nullif(F.xpath_string(xml, F.lit(f"{_ROOT}/{path}")), F.lit("")), F.lit("NULL"))


def _number(xml: Column, path: str) -> Column:
    return _text(xml, path).try_cast("double")


def landsat_fields(df: DataFrame, xml: str = "value") -> DataFrame:
    """Scene properties of Collection 2 MTL XML documents, by built-in XPath functions."""
    x = F.col(xml)
    pid = _text(x, "PRODUCT_CONTENTS/LANDSAT_PRODUCT_ID")
    parts = F.split(pid, "_")
    sat = F.substring(pid, 3, 2).try_cast("int")
    azimuth = _number(x, "IMAGE_ATTRIBUTES/SUN_AZIMUTH")
    nadir, roll = _text(x, "IMAGE_ATTRIBUTES/NADIR_OFFNADIR"), _number(x, "IMAGE_ATTRIBUTES/ROLL_ANGLE")
    lines, samples = _number(x, "PROJECTION_ATTRIBUTES/REFLECTIVE_LINES").cast("int"), _number(x, "PROJECTION_ATTRIBUTES/REFLECTIVE_SAMPLES").cast("int")
    tl, ts = _number(x, "PROJECTION_ATTRIBUTES/THERMAL_LINES").cast("int"), _number(x, "PROJECTION_ATTRIBUTES/THERMAL_SAMPLES").cast("int")
    gsd = _number(x, "LEVEL1_PROJECTION_PARAMETERS/GRID_CELL_SIZE_REFLECTIVE")
    corner = lambda axis: F.array(*(_number(x, f"PROJECTION_ATTRIBUTES/CORNER_{c}_PROJECTION_{axis}_PRODUCT") for c in ("UL", "UR", "LL", "LR")))
    d = df.withColumns(
        {
            "product_id": pid,
            "item_id": F.concat_ws("_", F.slice(parts, 1, 4), F.slice(parts, -2, 2)),
            "scene_id": _text(x, "LEVEL1_PROCESSING_RECORD/LANDSAT_SCENE_ID"),
            "satellite": sat,
            "processing_level": _text(x, "PRODUCT_CONTENTS/PROCESSING_LEVEL"),
            "utm_zone": _number(x, "PROJECTION_ATTRIBUTES/UTM_ZONE").cast("int"),
            "sr_shape": F.array(lines, samples),
            "thermal_shape": F.when(tl.isNotNull() & ts.isNotNull(), F.array(tl, ts)),
            "sr_gsd": gsd,
            "thermal_gsd": _number(x, "LEVEL1_PROJECTION_PARAMETERS/GRID_CELL_SIZE_THERMAL"),
            "proj_x": corner("X"),
            "proj_y": corner("Y"),
            "scene_datetime": F.try_to_timestamp(F.concat_ws(" ", _text(x, "IMAGE_ATTRIBUTES/DATE_ACQUIRED"), F.substring(_text(x, "IMAGE_ATTRIBUTES/SCENE_CENTER_TIME"), 1, 15)), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
            "cloud_cover": _number(x, "IMAGE_ATTRIBUTES/CLOUD_COVER"),
            "sun_azimuth": F.when(azimuth < 0, azimuth + 360).otherwise(azimuth),
            "sun_elevation": _number(x, "IMAGE_ATTRIBUTES/SUN_ELEVATION"),
            "off_nadir": F.when(nadir == "OFFNADIR", F.abs(roll)).otherwise(F.lit(0.0)),
            "wrs_path": F.lpad(_text(x, "IMAGE_ATTRIBUTES/WRS_PATH"), 3, "0"),
            "wrs_row": F.lpad(_text(x, "IMAGE_ATTRIBUTES/WRS_ROW"), 3, "0"),
        }
    )
    return d.withColumn("proj_bbox", F.array(F.array_min("proj_x") - gsd / 2, F.array_min("proj_y") - gsd / 2, F.array_max("proj_x") + gsd / 2, F.array_max("proj_y") + gsd / 2)).withColumn("sr_transform", F.array(gsd, F.lit(0.0), F.col("proj_bbox")[0], F.lit(0.0), -gsd, F.col("proj_bbox")[3])).drop("proj_x", "proj_y")


def radiance_constants(df: DataFrame, keys: list[str], xml: str = "value", bands: tuple[str, ...] = tuple(map(str, range(1, 12)))) -> DataFrame:
    """(keys, band, mult, add) of the level 1 radiance rescaling; bands without both are left out."""
    x = F.col(xml)
    at = "LEVEL1_RADIOMETRIC_RESCALING/RADIANCE_{}_BAND_{}"
    rows = F.array(*(F.struct(F.lit(f"B{b}").alias("band"), _number(x, at.format("MULT", b)).alias("mult"), _number(x, at.format("ADD", b)).alias("add")) for b in bands))
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("mult is not null and `add` is not null")


def angle_fields(df: DataFrame, text: str = "value") -> DataFrame:
    """Shape and corner arrays of angle coefficient files: the first value of each key."""
    t = F.col(text)
    numbers = lambda k: F.transform(F.split(F.regexp_extract(t, rf"{k}\s*=\s*\(([^)]*)\)", 1), r"\s*,\s*"), lambda v: v.try_cast("double"))
    one = lambda k: F.regexp_extract(t, rf"{k}\s*=\s*(\S+)", 1).try_cast("int")
    return df.withColumns({"lines": one("BAND01_NUM_L1T_LINES"), "samples": one("BAND01_NUM_L1T_SAMPS"), "corner_lines": numbers("BAND01_L1T_IMAGE_CORNER_LINES"), "corner_samples": numbers("BAND01_L1T_IMAGE_CORNER_SAMPS")})


def angle_footprint(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Closed ring of (lon, lat): corner pixels mapped linearly into the bounds [min_x, min_y, max_x, max_y]."""
    b = F.col(bbox)
    point = lambda s, l: F.struct((b[0] + s / F.col("samples") * (b[2] - b[0])).alias("lon"), (b[3] - l / F.col("lines") * (b[3] - b[1])).alias("lat"))  # noqa: E741, E731
    ring = F.zip_with("corner_samples", "corner_lines", point)
    return df.withColumn("footprint", F.concat(ring, F.slice(ring, 1, 1)))


def safe_footprint(coordinates: Column) -> Column:
    """"lat,lon lat,lon ..." as an array of (lon, lat)."""
    return F.transform(F.split(F.btrim(coordinates), r"\s+"), lambda p: F.struct(F.split(p, ",")[1].cast("double").alias("lon"), F.split(p, ",")[0].cast("double").alias("lat")))


def mid_time(start: Column, stop: Column) -> Column:
    """The moment half-way between two timestamps."""
    return F.timestamp_micros(((F.unix_micros(start) + F.unix_micros(stop)) / 2).cast("long"))


def band_of_image(name: Column) -> Column:
    """Band of a radar image name: the second of two hyphen parts, else the fourth; anything but a tiff is an error."""
    stem = F.regexp_replace(name, r"\.tiff?$", "")
    parts = F.split(stem, "-")
    band = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(3)))
    return F.when(name.rlike(r"\.tiff?$"), band).otherwise(F.raise_error(F.concat(F.lit("not an image: "), name)).cast("string"))


def asset_key(href: Column, kind: str) -> Column:
    """``<kind>-<polarisation>`` with the kind's own name, so that noise and calibration files never share a key."""
    return F.concat(F.lit(f"{kind}-"), F.lower(F.get(F.split(F.element_at(F.split(href, "/"), -1), "-"), F.lit(3 if kind == "product" else 4))))


def item_sensor(item_id: Column) -> Column:
    """struct(sensor, satellite, level, correction) from a Landsat item id."""
    sensors = {"M": "mss", "T": "tm", "E": "etm", "C": "oli-tirs"}
    s = F.substring(item_id, 2, 1)
    named = F.lit(None).cast("string")
    for k, v in sensors.items():
        named = F.when(s == k, v).otherwise(named)
    return F.struct(named.alias("sensor"), F.substring(item_id, 3, 2).cast("int").alias("satellite"), F.substring(item_id, 7, 1).alias("level"), F.substring(item_id, 8, 2).alias("correction"))


def renumbered_mss(band: Column, satellite: Column) -> Column:
    """Bands 1 to 4 of the first three satellites are numbered 4 to 7."""
    n = F.regexp_extract(band, r"^B([1-4])$", 1)
    return F.when((satellite < 4) & (n != ""), F.concat(F.lit("B"), (n.try_cast("int") + 3).cast("string"))).otherwise(band)


def asset_href(asset: Column) -> Column:
    """The storage address where an asset has one, else its own."""
    return F.coalesce(asset["alternate"]["s3"]["href"], asset["href"])


def stripped_keys(assets: Column) -> Column:
    """Asset keys without ``.TIF`` and values that are null."""
    return F.map_filter(F.transform_keys(assets, lambda k, v: F.regexp_replace(k, r"\.TIF$", "")), lambda k, v: v.isNotNull())


def granule_path(date: Column, granule: Column, beam: Column, group: Column) -> Column:
    """Storage path of a radar granule; month and day without leading zeros."""
    pol = F.substring(group, 7, 2)
    parts = F.split(granule, "_")
    number = lambda a: F.substring(date, *a).cast("int").cast("string")
    name = F.concat(F.substring(granule, 1, 3), F.lit("_IW_GRDH_1S"), pol, F.lit("_"), F.array_join(F.slice(parts, 5, F.size(parts)), "_"))
    return F.concat_ws("/", F.lit("s3://sentinel-s1-l1c/GRD"), F.substring(date, 1, 4), number((6, 2)), number((9, 2)), beam, pol, name)
