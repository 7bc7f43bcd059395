"""Scene metadata, catalogue items, graph writes, geography and round trips through files."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.operators import chips, frames, geo, graph
from tarn.plans import water
from tarn.queries.base import FRAMES, query, scratch, water_ts
from tarn.queries.base import frames as frames_of
from tarn.sources import items, metadata, sinks, tables
from tarn.sources import scenes as complete


def text(*parts) -> Column:
    """Strings and Columns as one text; Python strings that name no Column are literals."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def key() -> Column:
    """The customer, from which the metadata queries make their documents."""
    return F.col("c_custkey")


# files

@query(FRAMES + """ SELECT vec_id % 5 AS tile, DATE '2020-01-01' + CAST(vec_id % 4 AS INTEGER) AS date, count(*) AS n, CAST(sum(CAST(v > 0 AS INTEGER)) AS BIGINT) AS water FROM f WHERE vec_id % 4 BETWEEN 1 AND 2 AND vec_id % 5 IN (0, 2, 3) GROUP BY ALL""")
def tile_store(t, spark):
    """Masks written by partition, twice, and read back by constellation, tiles, dates and band."""
    root = scratch(spark)
    f = frames_of(t).select(F.lit("cnn").alias("model"), F.lit("sentinel-2").alias("constellation"), (F.col("vec_id") % 5).cast("string").alias("tile_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 4).cast("int")).alias("date"), (F.floor(F.col("vec_id") / 20) * 8 + F.col("y")).alias("y"), "x", (F.col("v") > 0).cast("int").alias("mask"))
    for _ in range(2):  # the second time replaces what the first wrote
        sinks.write_masks(f, root)
    d = tables.read_tiles(spark, root, "sentinel-2", ["0", "2", "3"], ["mask"], "2020-01-02", "2020-01-03")
    return d.groupBy(F.col("tile_id").cast("long").alias("tile"), "date").agg(F.count("*").alias("n"), F.sum("mask").alias("water"))


@query("SELECT DISTINCT event_type AS constellation, user_id AS tile_id, CAST(ts AS DATE) AS date FROM events")
def tile_dates(t, spark):
    return tables.tile_dates(t("events").select(F.col("event_type").alias("constellation"), F.col("user_id").alias("tile_id"), F.to_date("ts").alias("date")))


@query("SELECT CAST(vec_id AS INTEGER) AS dataset_index, 't' || vec_id AS timestamp, CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j FROM embeddings, generate_series(0, 3, 3) s(a), generate_series(0, 3, 3) r(b)")
def index_map_file(t, spark):
    """Whole chips as an index map, written without a header and read back."""
    path = scratch(spark)
    d = chips.chip_index(t("embeddings").select(F.col("vec_id").cast("int").alias("dataset_index"), text("t", F.col("vec_id")).alias("timestamp"), F.lit(8).alias("h"), F.lit(8).alias("w")), "h", "w", 3, ["dataset_index", "timestamp"])
    sinks.write_index_map(d, path)
    return tables.read_index_map(spark, path)


@query("""SELECT '{"aoi_id":"' || user_id || '","constellation":"' || event_type || '"}' AS dimensions, CAST(round(value, 2) AS VARCHAR) AS res_level, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS time FROM events""")
def revisit_measures(t, spark):
    """Multi-measure records, appended and read back."""
    path = scratch(spark)
    r = t("events").select(F.col("user_id").cast("string").alias("aoi_id"), F.col("event_type").alias("constellation"), F.col("ts").cast("timestamp").alias("time"), F.round("value", 2).alias("res_level"), F.lit(1.0).alias("cloud_coverage"))
    sinks.append_records(sinks.revisit_records(r), path)
    return spark.read.parquet(path).select("dimensions", F.col("measures")["res_level"].alias("res_level"), "time")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS granule, o_orderstatus AS beam, o_orderpriority AS polarisation FROM orders")
def granule_search(t, spark):
    """Search results as a file with a header; every column is text."""
    path = scratch(spark)
    t("orders").select(F.col("o_orderkey").alias("granule"), F.col("o_orderstatus").alias("beam"), F.col("o_orderpriority").alias("polarisation")).write.csv(path, header=True)
    return tables.read_granules(spark, path)


@query("SELECT 'tile' || n_nationkey AS tile, n_name AS spacecraft_id, '2020-01-0' || (n_nationkey % 9 + 1) AS datetime FROM nation")
def hand_labels(t, spark):
    """One object of objects, as a file."""
    path, k = scratch(spark), F.col("n_nationkey")
    one = F.struct(text("tile", k).alias("tile"), F.col("n_name").alias("spacecraft_id"), text("2020-01-0", k % 9 + 1).alias("datetime"))
    t("nation").groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k.cast("string"), one)))).alias("value")).write.text(path)  # 25 rows
    return tables.read_hand_labels(spark, path)


@query("SELECT user_id AS aoi_id, CAST(ts AS DATE) AS date, min(CAST(json_extract(props, '$.k') AS DOUBLE)) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts")
def event_service(t, spark):
    """Events as JSON lines, then one value for each area and time."""
    path = scratch(spark)
    e = t("events").select(F.col("user_id").alias("aoi_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"), F.array("event_type").alias("labels"), F.from_json("props", "map<string,string>").alias("keyed_values"))
    e.write.json(path)
    return tables.keyed_values(tables.read_events(spark, path), "click", "k")


@query("SELECT 'text of ' || n_name AS value FROM nation ORDER BY n_name OFFSET 3 LIMIT 1")
def nth_file(t, spark):
    """The fourth file of a folder by name."""
    path = scratch(spark)
    t("nation").select("n_name", text("text of ", F.col("n_name")).alias("value")).write.partitionBy("n_name").text(path)
    return tables.nth_file(spark, path + "/*", 3).select(F.btrim("value", F.lit("\n")).alias("value"))


@query("""SELECT o_orderkey AS k FROM orders WHERE o_custkey % 360 BETWEEN 10 AND 130 AND o_custkey % 90 BETWEEN 5 AND 60 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'""")
def seasonal_slice(t, spark):
    """Forecast cells by box and time; the data count longitudes from 0."""
    d = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 360).alias("longitude"), (F.col("o_custkey") % 90).alias("latitude"), F.to_date("o_orderdate").alias("time"))
    return tables.seasonal(d, (-169.8, 5.2, -50.1, 60.3), "1996-01-01", "1998-06-30").select("k")


@query("SELECT p_partkey AS id, CAST(count(*) AS INTEGER) AS rings, CAST(sum(a) AS DOUBLE) AS area FROM (SELECT p_partkey, unnest([p_size * (p_size + 1.0), 4.0]) AS a FROM part) GROUP BY 1")
def decoded_geometries(t, spark):
    """Well-known binary, as text, to rings and their areas: a box and, as a second polygon, a square."""
    box = lambda x, w, h: [(x, 0), (x + w, 0), (x + w, h), (x, h), (x, 0)]

    @F.pandas_udf("string")
    def packed(size):
        import struct

        polygon = lambda ring: struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
        return size.map(lambda n: (struct.pack("<BII", 1, 6, 2) + polygon(box(0, n, n + 1)) + polygon(box(100, 2, 2))).hex())

    w = t("part").select(F.col("p_partkey").alias("area_id"), F.col("p_name").alias("name"), packed("p_size").alias("geom"))
    d = w.withColumn("rings", tables.wkb_rings(F.unhex("geom")))
    return d.select(F.col("area_id").alias("id"), F.size("rings").alias("rings"), F.aggregate(F.transform("rings", geo.ring_area), F.lit(0.0), lambda s, a: s + a).alias("area"))


# metadata

@query("""WITH m AS (SELECT c_custkey AS id, unnest([{'path': 'L1/A', 'key': 'ID', 'value': CAST(c_custkey AS VARCHAR), 'kind': 'int'}, {'path': 'L1/A', 'key': 'NAME', 'value': c_name, 'kind': 'str'},
  {'path': 'L1/C', 'key': 'DATE_ACQUIRED', 'value': '2020-01-0' || (c_custkey % 9 + 1), 'kind': 'date'}, {'path': 'L1/B', 'key': 'GAIN', 'value': CAST(c_custkey % 7 + 0.5 AS VARCHAR), 'kind': 'float'},
  {'path': 'L1/B', 'key': 'ORIGIN', 'value': 'plain', 'kind': 'str'}]) AS r FROM customer) SELECT id, r.path AS path, r.key AS key, r.value AS value, r.kind AS kind FROM m""")
def mtl_items(t, spark):
    """Nested groups with typed values."""
    lines = text("GROUP = L1\n  GROUP = A\n    ID = ", key(), '\n    NAME = "', F.col("c_name"), '"\n  END_GROUP = A\n  GROUP = B\n    GAIN = ', key() % 7, ".5\n    ORIGIN = plain\n  END_GROUP = B\n  GROUP = C\n    DATE_ACQUIRED = 2020-01-0", key() % 9 + 1, "\n  END_GROUP = C\nEND_GROUP = L1\nEND\n")
    return metadata.mtl_items(t("customer").select(key().alias("id"), lines.alias("value")), "value", ["id"])


def element(path: str, *value) -> tuple:
    """A nested XML element."""
    names = path.split("/")
    return ("".join(f"<{n}>" for n in names), *value, "".join(f"</{n}>" for n in reversed(names)))


def scene_xml() -> Column:
    """A Collection 2 document of each customer."""
    flat = lambda *parts: [x for p in parts for x in p]
    pid = ("LC", "0", (key() % 2 + 8), "_", F.when(key() % 3 == 0, "L1TP").otherwise("L2SP"), "_", F.lpad((key() % 200).cast("string"), 3, "0"), F.lpad((key() % 100).cast("string"), 3, "0"), "_20200101_20200202_02_T1")
    corners = flat(*(element(f"CORNER_{c}_PROJECTION_{a}_PRODUCT", key() * 30 + dx if a == "X" else key() * 60 + dy) for c, dx, dy in (("UL", 0, 3000), ("UR", 6000, 3000), ("LL", 0, 0), ("LR", 6000, 0)) for a in "XY"))
    return text("<LANDSAT_METADATA_FILE>", "<PRODUCT_CONTENTS>", *element("LANDSAT_PRODUCT_ID", *pid), *element("PROCESSING_LEVEL", F.when(key() % 3 == 0, "L1TP").otherwise("L2SP")), *element("COLLECTION_CATEGORY", "T1"), *element("COLLECTION_NUMBER", "02"), "</PRODUCT_CONTENTS>",
                "<IMAGE_ATTRIBUTES>", *element("DATE_ACQUIRED", "2020-01-0", key() % 9 + 1), *element("SCENE_CENTER_TIME", "10:20:30.1234560Z"), *element("CLOUD_COVER", F.when(key() % 5 == 0, "-1").otherwise((key() % 100).cast("string"))), *element("SUN_AZIMUTH", key() % 360 - 180, ".5"), *element("SUN_ELEVATION", F.when(key() % 4 == 0, "NULL").otherwise((key() % 80).cast("string"))),
                *element("NADIR_OFFNADIR", F.when(key() % 2 == 0, "NADIR").otherwise("OFFNADIR")), *element("ROLL_ANGLE", "-", key() % 15), *element("WRS_PATH", key() % 233 + 1), *element("WRS_ROW", key() % 99 + 1), *element("WRS_TYPE", "2"), "</IMAGE_ATTRIBUTES>",
                "<PROJECTION_ATTRIBUTES>", *element("UTM_ZONE", key() % 60 + 1), *element("REFLECTIVE_LINES", "101"), *element("REFLECTIVE_SAMPLES", "201"), *corners, "</PROJECTION_ATTRIBUTES>",
                *element("LEVEL1_PROJECTION_PARAMETERS/GRID_CELL_SIZE_REFLECTIVE", "30.0"), *element("LEVEL1_PROCESSING_RECORD/LANDSAT_SCENE_ID", "S", key()),
                "<LEVEL1_RADIOMETRIC_RESCALING>", *element("RADIANCE_MULT_BAND_1", "0.01", key() % 9), *element("RADIANCE_ADD_BAND_1", "-", key() % 60), *element("RADIANCE_MULT_BAND_2", "0.5"), "</LEVEL1_RADIOMETRIC_RESCALING>", "</LANDSAT_METADATA_FILE>")


def scenes(t):
    return t("customer").select(key().alias("key"), scene_xml().alias("value"), text("s3://bucket/scene", key(), "_MTL.xml").alias("href"))


@query("""SELECT c_custkey AS key, 'LC0' || (c_custkey % 2 + 8) || '_' || CASE WHEN c_custkey % 3 = 0 THEN 'L1TP' ELSE 'L2SP' END || '_' || lpad(CAST(c_custkey % 200 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') || '_20200101_02_T1' AS item_id,
  'S' || c_custkey AS scene_id, CAST(c_custkey % 2 + 8 AS INTEGER) AS satellite, CAST(c_custkey % 60 + 1 AS INTEGER) AS utm_zone, CASE WHEN c_custkey % 5 = 0 THEN -1.0 ELSE c_custkey % 100 END::DOUBLE AS cloud_cover,
  CASE WHEN c_custkey % 360 < 180 THEN CASE WHEN c_custkey % 360 = 180 THEN 0.5 ELSE 360 - (180 - c_custkey % 360 + 0.5) END ELSE c_custkey % 360 - 180 + 0.5 END::DOUBLE AS sun_azimuth,
  CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 80 END::DOUBLE AS sun_elevation, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey % 15 END::DOUBLE AS off_nadir, lpad(CAST(c_custkey % 233 + 1 AS VARCHAR), 3, '0') AS wrs_path, lpad(CAST(c_custkey % 99 + 1 AS VARCHAR), 3, '0') AS wrs_row,
  (c_custkey * 30 - 15)::DOUBLE AS min_x, (c_custkey * 60 + 3015)::DOUBLE AS max_y, CAST(101 AS INTEGER) AS lines, make_timestamp(2020, 1, c_custkey % 9 + 1, 10, 20, 30.123456) AS scene_datetime FROM customer""")
def scene_fields(t, spark):
    """Scene properties from MTL XML by built-in XPath functions."""
    d = metadata.landsat_fields(scenes(t))
    return d.select("key", "item_id", "scene_id", "satellite", "utm_zone", "cloud_cover", "sun_azimuth", "sun_elevation", "off_nadir", "wrs_path", "wrs_row", F.col("proj_bbox")[0].alias("min_x"), F.col("sr_transform")[5].alias("max_y"), F.col("sr_shape")[0].alias("lines"), F.col("scene_datetime").cast("timestamp_ntz").alias("scene_datetime"))


@query("""SELECT c_custkey AS key, 'LC0' || (c_custkey % 2 + 8) || '_' || CASE WHEN c_custkey % 3 = 0 THEN 'L1TP' ELSE 'L2SP' END || '_' || lpad(CAST(c_custkey % 200 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') || '_20200101_02_T1' AS id,
  'landsat-' || (c_custkey % 2 + 8) AS platform, 'oli-tirs' AS instruments, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 100 AS VARCHAR) || '.0' END AS cloud, CAST(CASE WHEN c_custkey % 3 = 0 THEN 16 ELSE 25 END AS INTEGER) AS n_assets,
  's3://bucket/scene' || c_custkey || '_SR_B4.TIF' AS red, CASE WHEN c_custkey % 3 <> 0 THEN 's3://bucket/scene' || c_custkey || '_ST_B10.TIF' END AS thermal FROM customer""")
def landsat_items(t, spark):
    """Catalogue items: thermal assets only for L2SP, cloud cover only where it is known."""
    x = scenes(t)
    d = items.landsat_items(x).select(F.element_at(F.split(F.col("assets")["MTL.xml"], "scene"), 2).alias("key"), "id", "properties", "assets")
    p, a = F.col("properties"), F.col("assets")
    return d.select(F.regexp_extract("key", r"^\d+", 0).cast("long").alias("key"), "id", p["platform"].alias("platform"), p["instruments"].alias("instruments"), F.try_element_at(p, F.lit("eo:cloud_cover")).alias("cloud"), F.size(a).alias("n_assets"), a["SR_B4"].alias("red"), F.try_element_at(a, F.lit("ST_B10")).alias("thermal"))


@query("SELECT c_custkey AS key, 'B1' AS band, CAST('0.01' || (c_custkey % 9) AS DOUBLE) AS mult, -(c_custkey % 60)::DOUBLE AS \"add\" FROM customer")
def radiance_constants(t, spark):
    """Rescaling constants of the bands that have both."""
    d = metadata.radiance_constants(scenes(t), ["key"])
    return d.select("key", "band", "mult", (F.col("add") + 0.0).alias("add"))


@query("""WITH r AS (SELECT c_custkey AS id, unnest([0, 1, 2, 3, 4]) AS i FROM customer) SELECT id, CAST(i AS INTEGER) AS i, round(10 + [0, id % 50, 100, 40, 0][i + 1] / 100.0 * 2, 6) AS lon, round(22 - [0, 0, id % 70, 200, 0][i + 1] / 200.0 * 2, 6) AS lat FROM r""")
def angle_footprints(t, spark):
    """Corner pixels of angle files as a closed ring in degrees."""
    v = text("BAND01_NUM_L1T_LINES = 200\nBAND01_NUM_L1T_SAMPS = 100\n BAND01_L1T_IMAGE_CORNER_LINES = (0, 0, ", key() % 70, ", 200)\n BAND01_L1T_IMAGE_CORNER_SAMPS = (0,", key() % 50, ",100, 40)\nBAND02_NUM_L1T_LINES = 1")
    d = metadata.angle_footprint(metadata.angle_fields(t("customer").select(key().alias("id"), v.alias("value"), F.array(*map(F.lit, (10.0, 20.0, 12.0, 22.0))).alias("bbox"))))
    p = d.select("id", F.posexplode("footprint").alias("i", "p"))
    return p.select("id", "i", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("""SELECT c_custkey AS id, 'IW' AS mode, 'VV,VH' AS polarisations, CASE WHEN c_custkey % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state, CAST(c_custkey AS INTEGER) AS absolute_orbit, CAST(c_custkey % 175 AS INTEGER) AS relative_orbit, CAST(c_custkey + 1 AS INTEGER) AS samples,
  c_custkey % 180 + 0.5::DOUBLE AS lon, (c_custkey % 80)::DOUBLE AS lat, make_timestamp(2020, 1, 1, 0, 0, 15 + (c_custkey % 20) / 2.0) AS mid, 'vv' AS band, 'calibration-vh' AS asset, 5.405::DOUBLE AS frequency FROM customer""")
def radar_scenes(t, spark):
    """A radar manifest: instrument, orbit, outline, middle of the time, bands and asset keys."""
    xml = text("<m xmlns:s1sarl1='a' xmlns:safe='b' xmlns:s1='c'>", "<s1sarl1:mode>IW</s1sarl1:mode><s1sarl1:transmitterReceiverPolarisation>VV</s1sarl1:transmitterReceiverPolarisation><s1sarl1:transmitterReceiverPolarisation>VH</s1sarl1:transmitterReceiverPolarisation>",
               "<s1:pass>", F.when(key() % 2 == 0, "ASCENDING").otherwise("DESCENDING"), "</s1:pass><safe:orbitNumber>", key(), "</safe:orbitNumber><safe:relativeOrbitNumber>", key() % 175, "</safe:relativeOrbitNumber><numberOfSamples>", key() + 1, "</numberOfSamples><numberOfLines>7</numberOfLines></m>")
    d = items.radar_fields(t("customer").select(key().alias("id"), xml.alias("value")))
    start = F.lit("2020-01-01 00:00:10").cast("timestamp")
    ring = metadata.safe_footprint(text(F.col("id") % 80, ",", F.col("id") % 180, ".5 ", "1,2 3,4"))
    name = F.lit("s1a-iw-grd-vv-20200101-1.tiff")
    return d.select("id", "mode", F.array_join("polarisations", ",").alias("polarisations"), "orbit_state", "absolute_orbit", "relative_orbit", F.col("shape")[0].alias("samples"), ring[0]["lon"].alias("lon"), ring[0]["lat"].alias("lat"),
                    metadata.mid_time(start, F.timestamp_micros(F.unix_micros(start) + (10 + F.col("id") % 20) * 1000000)).cast("timestamp_ntz").alias("mid"), metadata.band_of_image(name).alias("band"), metadata.asset_key(F.lit("./x/calibration-s1a-iw-grd-vh-1.xml"), "calibration").alias("asset"), F.col("sar_center_frequency").alias("frequency"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 9 AS VARCHAR) ELSE CAST(c_custkey % 7 AS VARCHAR) END AS off_nadir, 'Landsat' AS constellation, 'SR_B4' AS assets, c_name AS level FROM customer""")
def upgraded_items(t, spark):
    """Items of the old form in the new."""
    p = F.create_map(F.when(key() % 2 == 0, "eo:off_nadir").otherwise("view:off_nadir"), F.when(key() % 2 == 0, (key() % 9).cast("string")).otherwise((key() % 7).cast("string")), F.lit("constellation"), F.lit("old"), F.lit("landsat:correction"), F.col("c_name"))
    d = items.upgraded(t("customer").select(key().alias("id"), p.alias("properties"), F.create_map(F.lit("SR_B4.TIF"), F.lit("a"), F.lit("QA.TIF"), F.lit(None).cast("string")).alias("assets")))
    q = items.legacy_properties(F.col("properties"))
    return d.select("id", F.col("properties")["view:off_nadir"].alias("off_nadir"), F.col("properties")["constellation"].alias("constellation"), F.array_join(F.map_keys("assets"), ",").alias("assets"), q["landsat:processing_level"].alias("level"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' WHEN o_orderkey % 5 <> 0 THEN 'served' END AS geometry FROM orders""")
def item_geometries(t, spark):
    """Storage first, then the service, where it has exactly one."""
    o, k = t("orders").select(F.col("o_orderkey").alias("id")), F.col("id")
    served = o.withColumn("geometry", F.lit("served"))
    return items.with_geometry(o, o.where(k % 3 == 0).withColumn("geometry", F.lit("stored")), served.unionByName(served.where(k % 5 == 0))).select("id", "geometry")


@query("""SELECT c_custkey AS id, ['mss', 'tm', 'etm', 'oli-tirs'][c_custkey % 4 + 1] AS sensor, CAST(c_custkey % 9 + 1 AS INTEGER) AS satellite, '2' AS level, 'SP' AS correction, CASE WHEN c_custkey % 2 = 0 THEN 's3' ELSE 'https' END AS href FROM customer""")
def item_sensors(t, spark):
    """Sensor, satellite and level from item ids; the storage address where there is one."""
    d = t("customer").select(key().alias("id"), text("L", F.element_at(F.array(*map(F.lit, "MTEC")), (key() % 4 + 1).cast("int")), "0", key() % 9 + 1, "_L2SP_001").alias("item"), F.struct(F.lit("https").alias("href"), F.struct(F.struct(F.when(key() % 2 == 0, "s3").alias("href")).alias("s3")).alias("alternate")).alias("asset"))
    return d.select("id", metadata.item_sensor(F.col("item")).alias("s"), metadata.asset_href(F.col("asset")).alias("href")).select("id", "s.*", "href")


@query("""SELECT p_partkey AS id FROM part WHERE p_size IN (10, 20, 30) AND p_partkey % 2 = 0 AND p_partkey * 37 % 1000 <= 700 AND p_partkey * 37 % 1000 + 50 >= 100 AND p_partkey % 12 + 1 BETWEEN 3 AND 9 AND p_partkey % 4 = 0
  AND p_partkey % 3 = (WITH e AS (SELECT p_partkey % 3 AS e, count(*) AS n FROM part WHERE p_size IN (10, 20, 30) AND p_partkey % 4 = 0 AND p_partkey * 37 % 1000 <= 700 AND p_partkey * 37 % 1000 + 50 >= 100 AND p_partkey % 12 + 1 BETWEEN 3 AND 9 GROUP BY 1) SELECT e FROM e ORDER BY n DESC, e LIMIT 1)""")
def item_search(t, spark):
    """Radar items by collection, box, time, orbit and properties, in their most frequent projection."""
    k = F.col("p_partkey")
    d = t("part").select(k.alias("id"), F.when(k % 2 == 0, "sentinel1-grd").otherwise("landsat-c2").alias("collection"), (k * 37 % 1000).alias("min_x"), (k * 37 % 1000 + 50).alias("max_x"), F.lit(0).alias("min_y"), F.lit(5).alias("max_y"), (k % 12 + 1).alias("datetime"), F.when(k % 4 == 0, "ascending").otherwise("descending").alias("orbit_state"), (k % 3).cast("int").alias("epsg"), "p_size")
    return tables.search_items(d, "sentinel1-grd", (100, 0, 700, 5), (3, 9), {"p_size": {"in": [10, 20, 30]}}, "ascending").select("id")


SENSOR = "s AS (SELECT c_custkey AS k, c_custkey % 4 = 0 AS scanner, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 8 < 4 THEN 2 ELSE 4 END WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 8 END AS sat, c_custkey % 3 <> 0 AS l2 FROM customer)"


@query(f"""WITH {SENSOR} SELECT k AS key, 'landsat-' || sat AS platform, CAST(CASE WHEN scanner THEN 79 ELSE 30 END AS INTEGER) AS gsd, CASE k % 4 WHEN 0 THEN 'mss' WHEN 1 THEN 'tm' WHEN 2 THEN 'etm+' ELSE 'oli,tirs' END AS instruments,
  CAST(CASE WHEN scanner THEN 2 WHEN l2 THEN 4 ELSE 3 END AS INTEGER) AS n_assets, 's3://bucket/scene' || k || CASE WHEN sat = 2 THEN '_B4.TIF' ELSE '_B1.TIF' END AS green, CASE WHEN sat = 2 THEN 'B4' ELSE 'B1' END AS band,
  CASE WHEN NOT scanner OR sat = 4 AND k % 60 <> 0 THEN 'u' END AS unit, CASE WHEN NOT scanner THEN 0.5 WHEN sat = 4 AND k % 60 <> 0 THEN CAST('0.01' || (k % 9) AS DOUBLE) END AS scale,
  CASE WHEN l2 AND NOT scanner THEN CAST(CASE k % 4 WHEN 1 THEN 120 WHEN 2 THEN 60 ELSE 100 END AS INTEGER) END AS thermal_gsd, CAST(CASE WHEN l2 THEN 2 ELSE 1 END AS INTEGER) AS n_via, 'Level-' || CASE WHEN l2 THEN 2 ELSE 1 END || ' file' AS described FROM s""")
def scene_items(t, spark):
    """Items of all four sensors from a table of asset definitions."""
    letter = F.element_at(F.array(*map(F.lit, "MTEC")), (key() % 4 + 1).cast("int"))
    satellite = F.when(key() % 8 == 0, "2").when(key() % 4 == 0, "4").when(key() % 4 == 1, "5").when(key() % 4 == 2, "7").otherwise("8")
    d = t("customer").select(key().alias("key"), F.regexp_replace(scene_xml(), F.lit(r"<LANDSAT_PRODUCT_ID>LC0\d"), F.concat(F.lit("<LANDSAT_PRODUCT_ID>L"), letter, F.lit("0"), satellite)).alias("value"), text("s3://bucket/scene", key(), "_MTL.xml").alias("href"))
    asset = lambda title, end, description=None: (title, description, None, ["data"], end)
    own = lambda sensor: (("B1", "uint8", None, "u", None, None, 60.0) if sensor == "mss" else (None, "uint16", "0", "u", 0.5, 0.0, 30.0))
    rows = []
    for sensor in complete.INSTRUMENTS:
        rows += [(sensor, "common", 0, "ang", asset("Angles", "ANG.txt"), None, None), (sensor, "common", 1, "mtl.xml", asset("Metadata", "MTL.xml", "Level-X file"), None, None)]
        rows += [(sensor, "sr", 0, "green", asset("Green (B1)", "B1.TIF"), ("B1", "green", None, 0.55, 0.1), own(sensor))]
        rows += [(sensor, "st", 0, "lwir11", asset("Thermal", None), None, None)] if sensor != "mss" else []
    got = complete.scene_items(d, spark.createDataFrame(rows, complete.DEFINITION))
    a = F.col("assets")
    green, thermal = a["green"], F.try_element_at(a, F.lit("lwir11"))
    return got.select(F.regexp_extract(a["mtl.xml"]["href"], r"scene(\d+)", 1).cast("long").alias("key"), "platform", "gsd", F.array_join("instruments", ",").alias("instruments"), F.size(a).alias("n_assets"), green["href"].alias("green"), green["band"]["name"].alias("band"), green["raster"]["unit"].alias("unit"), green["raster"]["scale"].alias("scale"), thermal["gsd"].alias("thermal_gsd"), F.size("via").alias("n_via"), a["mtl.xml"]["description"].alias("described"))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 0.0::DOUBLE END AS off_nadir, CAST(CASE WHEN c_custkey % 3 = 0 THEN 16 ELSE 25 END AS INTEGER) AS n_assets, 30.0::DOUBLE AS red_gsd, 'red' AS red, 0.65::DOUBLE AS wavelength, CAST(201 AS INTEGER) AS samples,
  CASE WHEN c_custkey % 3 <> 0 THEN 100.0::DOUBLE END AS thermal_gsd, CASE WHEN c_custkey % 3 = 0 THEN 'L1TP' ELSE 'L2SP' END AS level, CAST(32601 + c_custkey % 60 AS INTEGER) AS epsg, lpad(CAST(c_custkey % 233 + 1 AS VARCHAR), 3, '0') || '/' || lpad(CAST(c_custkey % 99 + 1 AS VARCHAR), 3, '0') AS page FROM customer""")
def older_scene_items(t, spark):
    """Items of the older form: distances, bands and shapes of each image."""
    d = complete.legacy_items(scenes(t))
    a = F.col("assets")
    red, thermal = a["SR_B4"], F.try_element_at(a, F.lit("ST_B10"))
    return d.select(F.regexp_extract(a["MTL.xml"]["href"], r"scene(\d+)", 1).cast("long").alias("key"), "off_nadir", F.size(a).alias("n_assets"), red["gsd"].alias("red_gsd"), red["band"]["common_name"].alias("red"), red["band"]["center_wavelength"].alias("wavelength"), red["proj_shape"][1].alias("samples"), thermal["gsd"].alias("thermal_gsd"), F.col("properties")["landsat:processing_level"].alias("level"), "epsg", F.regexp_extract("alternate", r"/2020/(\d+/\d+)/", 1).alias("page"))


@query("""SELECT c_custkey AS key, 'S1A_IW_' || c_custkey AS id, 'SENTINEL-1A' AS platform, make_timestamp(2020, 1, 1, 0, 0, 15 + (c_custkey % 20) / 2.0) AS datetime, (c_custkey % 180)::DOUBLE AS min_x, (c_custkey % 80)::DOUBLE AS min_y, (c_custkey % 180 + 2)::DOUBLE AS max_x,
  CASE WHEN c_custkey % 2 = 0 THEN 'calibration-iw-vh,noise-iw-vh,product-iw-vh,safe-manifest,thumbnail,vh' ELSE 'product-iw-vh,safe-manifest,thumbnail,vh,vv' END AS assets, CAST(c_custkey + 1 AS INTEGER) AS samples, 's3://b/S1A_IW_' || c_custkey || '.SAFE/preview/quick-look.png' AS thumbnail FROM customer""")
def radar_items(t, spark):
    """Radar items with their assets."""
    tag = lambda n, *v: (f"<{n}>", *v, f"</{n}>")
    stop = F.date_format(F.timestamp_micros(F.unix_micros(F.lit("2020-01-01 00:00:20").cast("timestamp")) + key() % 20 * 1000000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    xml = text("<m xmlns:safe='a' xmlns:gml='b'>", *tag("safe:familyName", "SENTINEL-1"), *tag("safe:number", "A"), *tag("safe:startTime", "2020-01-01T00:00:10.000000"), *tag("safe:stopTime", stop), *tag("gml:coordinates", key() % 80, ",", key() % 180, " ", key() % 80 + 1, ",", key() % 180 + 2), "</m>")
    base = text("s3://b/S1A_IW_", key(), ".SAFE/")
    at = lambda *paths: F.array(*(F.concat(base, F.lit(p)) for p in ("annotation/iw-vh.xml", "measurement/iw-vh.tiff", *paths)))
    files = F.when(key() % 2 == 0, at("annotation/calibration/calibration-iw-vh.xml", "annotation/calibration/noise-iw-vh.xml")).otherwise(at("measurement/iw-vv.tiff", "support/a.xsd"))
    shape = text("<a>", *tag("numberOfSamples", key() + 1), *tag("numberOfLines", "7"), "</a>")
    d = complete.radar_items(t("customer").select(xml.alias("value"), shape.alias("annotation"), F.concat(base, F.lit("manifest.safe")).alias("href"), files.alias("files")))
    b = F.col("bbox")
    return d.select(F.element_at(F.split("id", "_"), -1).cast("long").alias("key"), "id", "platform", F.col("datetime").cast("timestamp_ntz").alias("datetime"), b[0].alias("min_x"), b[1].alias("min_y"), b[2].alias("max_x"), F.array_join(F.array_sort(F.map_keys("assets")), ",").alias("assets"), F.col("proj_shape")[0].alias("samples"), F.col("assets")["thumbnail"]["href"].alias("thumbnail"))


# graph

@query("""SELECT 'revisit' AS kind, count(*) AS n, min(CAST(event_id AS VARCHAR)) AS first FROM events UNION ALL SELECT 'captures', count(*), min(event_type) FROM events UNION ALL SELECT 'on', count(*), min(CAST(event_id AS VARCHAR)) FROM events""")
def graph_batch(t, spark):
    """New revisits as vertices and edges, written together and read by batch."""
    root = scratch(spark)
    v, e = graph.revisit_rows(t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("satellite"), F.col("user_id").alias("aoi")))
    sinks.write_together({"vertices": v, "edges": e}, root)
    v, e = (sinks.read_batches(spark, root, n) for n in ("vertices", "edges"))
    return v.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("first")).unionByName(e.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n"), F.min("src").alias("first")))


@query("""WITH e AS (SELECT user_id AS id, event_type AS name, value, event_id FROM events) SELECT id, name, CAST(CASE WHEN name = 'click' THEN count(*) ELSE 1 END AS INTEGER) AS n, arg_min(value, event_id) AS first FROM e GROUP BY id, name""")
def merged_attributes(t, spark):
    """Attributes of vertices: one kind is gathered in order, others keep the first."""
    e = t("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), "value", "event_id")
    d = graph.merge_attributes(e.select("id").distinct(), e, ["click"], "event_id")
    return d.select("id", "name", F.size("values").alias("n"), F.col("values")[0].alias("first"))


@query("""SELECT l_returnflag AS k, min(l_quantity) AS x0, min(l_tax) AS y0, max(l_quantity) AS x1, max(l_tax) AS y1, CAST(count(DISTINCT l_linenumber) AS INTEGER) AS n FROM lineitem GROUP BY 1""")
def coordinate_attributes(t, spark):
    d = graph.coordinate_attributes(t("lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.col("l_linenumber").alias("time")), ["k"])
    b = F.col("bbox")
    return d.select("k", b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1"), F.size("times").alias("n"))


# geography

PLACES = "p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 16000) / 100.0 - 80 + 0.005 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 + 0.005 AS lon FROM customer)"


def places(t):
    return t("customer").select(key().alias("id"), (key() * 7919 % 16000 / 100.0 - 80 + 0.005).alias("lat"), (key() * 104729 % 36000 / 100.0 - 180 + 0.005).alias("lon"))


def utm_sql(source: str, columns: str) -> str:
    """(columns, x, y) of points (lat, lon, zone, south): the transverse Mercator series, written out."""
    a, alpha, _, _ = geo._series()
    e = (geo.FLAT * (2 - geo.FLAT)) ** 0.5
    terms = lambda f, g: " + ".join(f"{c!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(alpha, 1))
    return f"""(WITH a AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS l FROM {source}),
  b AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM a)
  SELECT {columns}, {geo.EAST0} + {geo.K0 * a!r} * (eta + {terms('cos', 'sinh')}) AS x, CASE WHEN south THEN {geo.NORTH0} ELSE 0 END + {geo.K0 * a!r} * (xi + {terms('sin', 'cosh')}) AS y FROM b)"""


@query(f"WITH {PLACES}, q AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, lat <= 0 AS south FROM p) SELECT id, round(x, 2) AS x, round(y, 2) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {utm_sql('q', 'id, lat, lon')}")
def utm_projection(t, spark):
    """Degrees to metres and back."""
    d = places(t).withColumn("zone", (F.floor((F.col("lon") + 180) / 6) + 1).cast("double")).withColumn("south", F.col("lat") <= 0)
    d = d.withColumn("m", geo.utm_xy("lat", "lon", "zone", "south"))
    d = d.withColumn("d", geo.utm_lonlat("m.x", "m.y", "zone", "south"))
    return d.select("id", F.round("m.x", 2).alias("x"), F.round("m.y", 2).alias("y"), F.round("d.lat", 6).alias("lat"), F.round("d.lon", 6).alias("lon"))


BOXED = """b AS (SELECT id AS area_id, lon AS min_x, lat AS min_y, lon + 0.04 AS max_x, lat + 0.03 AS max_y, CAST(floor((lon + 0.02 + 180) / 6) AS INTEGER) + 1 AS zone, lat + 0.015 <= 0 AS south FROM p WHERE abs(lat) < 70 AND lon < 179),
e AS (SELECT *, unnest(generate_series(0, 16)) / 16.0::DOUBLE AS s FROM b),
edge AS (SELECT area_id, zone, south, min_x + s * (max_x - min_x) AS lon, min_y AS lat FROM e UNION ALL SELECT area_id, zone, south, max_x, min_y + s * (max_y - min_y) FROM e
  UNION ALL SELECT area_id, zone, south, min_x + s * (max_x - min_x), max_y FROM e UNION ALL SELECT area_id, zone, south, min_x, min_y + s * (max_y - min_y) FROM e)"""


@query(f"""WITH {PLACES}, {BOXED}, m AS (SELECT area_id, zone, south, CAST(floor(min(x) / 10000) AS BIGINT) AS i0, CAST(floor(max(x) / 10000) AS BIGINT) AS i1, CAST(floor(min(y) / 10000) AS BIGINT) AS j0, CAST(floor(max(y) / 10000) AS BIGINT) AS j1 FROM {utm_sql('edge', 'area_id, zone, south')} GROUP BY ALL),
i AS (SELECT *, unnest(generate_series(i0, i1)) AS i FROM m) SELECT area_id, zone, i * 10000 AS min_x, unnest(generate_series(j0, j1)) * 10000 AS min_y, CAST(CASE WHEN south THEN 32700 ELSE 32600 END + zone AS INTEGER) AS epsg FROM i""")
def tiles_of_areas(t, spark):
    """Every UTM tile that an area's box meets."""
    b = places(t).where("abs(lat) < 70 and lon < 179").select(F.col("id").alias("area_id"), F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), (F.col("lon") + 0.04).alias("max_x"), (F.col("lat") + 0.03).alias("max_y"))
    return geo.tiles_of_boxes(b).select("area_id", "zone", "min_x", "min_y", "epsg")


@query("""SELECT c_custkey AS id, CAST(i AS INTEGER) AS i, (c_custkey % 60 + 10) * 10000 + CASE WHEN i IN (1, 2) THEN 10000 ELSE 0 END AS x, (c_custkey % 800 + 50) * 10000 + CASE WHEN i IN (2, 3) THEN 10000 ELSE 0 END AS y FROM customer, generate_series(0, 4) s(i)""")
def tile_outlines(t, spark):
    """Outlines of tiles in degrees; projected again they are the tiles' corners."""
    ids = t("customer").select(key().alias("area_id"), F.array(F.concat_ws("_", F.lit("33"), F.lit("Q"), F.lit("10000"), key() % 60 + 10, key() % 800 + 50)).alias("tiles"))
    d = geo.tile_rings(geo.tile_from_id(ids.select(F.col("area_id").alias("id"), F.explode("tiles").alias("tile_id"))))
    p = d.select("id", F.posexplode("ring").alias("i", "p")).withColumn("m", geo.utm_xy("p.lat", "p.lon", F.lit(33.0), F.lit(False)))
    return p.select("id", "i", F.round("m.x").cast("long").alias("x"), F.round("m.y").cast("long").alias("y"))


@query("""SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 10 < 8 THEN CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 < 3 THEN 32700 ELSE 32600 END + c_custkey % 60 + 1 WHEN c_custkey % 10 = 8 THEN 3031 ELSE 3995 END AS INTEGER) AS epsg, 100.0 - 15 AS min_x, 260.0 + 15 AS max_y, (c_custkey % 360 - CASE WHEN c_custkey % 360 > 180 THEN 360 ELSE 0 END)::DOUBLE AS lon, c_custkey % 9 AS low, c_custkey % 9 + 5 AS high FROM customer""")
def scene_places(t, spark):
    """Projection codes, bounds of pixel centres, longitudes beyond the antimeridian, bounding boxes."""
    zone = F.when(key() % 10 < 8, key() % 60 + 1).cast("int")
    epsg = geo.landsat_epsg(zone, F.when(key() % 7 < 3, -5.0).otherwise(5.0), F.when(key() % 2 == 0, 8).otherwise(7), F.when(key() % 10 == 8, -71).otherwise(71))
    box = geo.proj_bbox(F.array(F.lit(100.0), F.lit(400.0)), F.array(F.lit(20.0), F.lit(260.0)), F.lit(30.0))
    points = geo.bounding_box(F.array(*(F.struct((key() % 9 + d).alias("x"), F.lit(1).alias("y")) for d in (5, 0, 2))))
    return t("customer").select(key().alias("id"), epsg.alias("epsg"), box["min_x"].alias("min_x"), box["max_y"].alias("max_y"), geo.unwrapped(F.array((key() % 360).cast("double")))[0].alias("lon"), points["min_x"].alias("low"), points["max_x"].alias("high"))


RINGS = "r AS (SELECT p_partkey AS id, p_partkey % 11 + 0.25 AS x0, p_partkey % 7 + 0.25 AS y0, p_size % 6 + 1.5 AS w, p_size % 5 + 1.5 AS h FROM part)"


def rings(t):
    p, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (p % 11 + 0.25).cast("double"), (p % 7 + 0.25).cast("double")
    x1, y1 = x0 + s % 6 + 1.5, y0 + s % 5 + 1.5
    corner = lambda x, y: F.struct(x.alias("x"), (20 - y).alias("y"))
    return t("part").select(p.alias("id"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)).alias("ring"))


@query(f"WITH {RINGS} SELECT id, CAST((floor(x0 + w) - floor(x0) + 1) * (floor(y0 + h) - floor(y0) + 1) AS BIGINT) AS touched, CAST((floor(x0 + w - 0.5) - ceil(x0 - 0.5) + 1) * (floor(y0 + h - 0.5) - ceil(y0 - 0.5) + 1) AS BIGINT) AS centres, round(w * h, 6)::DOUBLE AS area FROM r")
def rasterised(t, spark):
    """Boxes as pixels: all that are touched, and those whose centre is inside; and their area as rings."""
    r = rings(t)
    n = lambda touched, name: frames.burned(r, "id", 20, 20, 0.0, 20.0, 1.0, touched).groupBy("id").agg(F.count("*").alias(name))
    return n(True, "touched").join(n(False, "centres"), "id").join(r.select("id", F.round(geo.ring_area(F.col("ring")), 6).alias("area")), "id")


# series and served points

@query("""SELECT user_id AS area_id, event_type AS constellation, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_id % 3 = 1 GROUP BY ALL""")
def runs_of_model(t, spark):
    """Rows of the runs of one model, by a pattern on the run id."""
    name = F.element_at(F.array(*map(F.lit, ("pekel", "c_n", "cnn"))), (F.col("event_id") % 3 + 1).cast("int"))
    d = t("events").select(F.col("user_id").alias("area_id"), F.col("event_type").alias("constellation"), "value", text("20200101-", name, "-v", F.col("event_id")).alias("run_id"))
    return water.of_model(d, "c_n").groupBy("area_id", "constellation").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT area_id, constellation, CAST(count(*) AS INTEGER) AS n FROM (SELECT DISTINCT user_id AS area_id, event_type AS constellation, CAST(ts AS DATE) AS date FROM events WHERE value > 0 AND user_id = 7) GROUP BY ALL")
def served_area(t, spark):
    """The nested response of one area."""
    d = water.timeseries_response(water_ts(t), 7, resample=False)
    return d.select("area_id", F.explode("series").alias("constellation", "s")).select("area_id", "constellation", F.size("s").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4")
def dimension_lookup(t, spark):
    return water.lookup(t("customer"), "c_nationkey", 4).select("c_custkey", "c_name")


@query("SELECT event_type AS constellation, count(*) AS n FROM events GROUP BY 1")
def concatenated_series(t, spark):
    """The union of the constellations' own series."""
    e = t("events").select(F.col("event_type").alias("constellation"), "value")
    kinds = ("click", "view", "cart", "purchase", "search")
    rest = e.where(~F.col("constellation").isin(*kinds))
    return water.all_constellations([*(e.where(F.col("constellation") == k) for k in kinds), rest]).groupBy("constellation").agg(F.count("*").alias("n"))
