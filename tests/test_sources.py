import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarn.plans import water
from tarn.sources import metadata, sinks, tables
from tarn.streaming import incremental

MTL = """GROUP = L1_METADATA_FILE
  GROUP = IMAGE_ATTRIBUTES
    CLOUD_COVER = 12.50
    SUN_ELEVATION = 4.5E+01
    WRS_PATH = 20
    DATE_ACQUIRED = 2020-03-04
    SCENE_CENTER_TIME = "10:11:12.1234567Z"
    FILE_DATE = 2020-03-05T01:02:03Z
    ORIGIN = "Image = x"
    NOTE = free text
  END_GROUP = IMAGE_ATTRIBUTES
END_GROUP = L1_METADATA_FILE
END
"""


def test_mtl():
    g = metadata.parse_mtl(MTL.replace('"Image = x"', '"Image x"'))["L1_METADATA_FILE"]["IMAGE_ATTRIBUTES"]
    assert g["CLOUD_COVER"] == 12.5 and g["WRS_PATH"] == 20 and g["DATE_ACQUIRED"] == dt.date(2020, 3, 4)
    assert g["SCENE_CENTER_TIME"] == dt.time(10, 11, 12, 123456) and g["FILE_DATE"] == dt.datetime(2020, 3, 5, 1, 2, 3)
    assert g["ORIGIN"] == "Image x" and g["NOTE"] == "free text" and g["SUN_ELEVATION"] == 45.0


@pytest.mark.parametrize("bad", ["A = 1\n", "GROUP = A\nEND_GROUP = B\n", "GROUP = A\nEND\n", "GROUP = A\nnonsense\n"])
def test_mtl_errors(bad):
    with pytest.raises(metadata.MtlError):
        metadata.parse_mtl(bad)


def test_mtl_items(spark):
    d = metadata.mtl_items(spark.createDataFrame([("s", MTL)], "scene string, value string"), keys=["scene"])
    r = {x.key: x for x in d.collect()}
    assert r["WRS_PATH"].path == "L1_METADATA_FILE/IMAGE_ATTRIBUTES" and r["WRS_PATH"].kind == "int" and r["CLOUD_COVER"].value == "12.5"


XML = """<LANDSAT_METADATA_FILE><PRODUCT_CONTENTS><LANDSAT_PRODUCT_ID>LC08_L2SP_017036_20130419_20200913_02_T2</LANDSAT_PRODUCT_ID><PROCESSING_LEVEL>L2SP</PROCESSING_LEVEL></PRODUCT_CONTENTS>
<IMAGE_ATTRIBUTES><CLOUD_COVER>31.5</CLOUD_COVER><SUN_AZIMUTH>-40.5</SUN_AZIMUTH><SUN_ELEVATION>61.1</SUN_ELEVATION><NADIR_OFFNADIR>OFFNADIR</NADIR_OFFNADIR><ROLL_ANGLE>-0.25</ROLL_ANGLE><WRS_PATH>17</WRS_PATH><WRS_ROW>36</WRS_ROW><DATE_ACQUIRED>2013-04-19</DATE_ACQUIRED><SCENE_CENTER_TIME>16:06:01.5150000Z</SCENE_CENTER_TIME></IMAGE_ATTRIBUTES>
<PROJECTION_ATTRIBUTES><UTM_ZONE>17</UTM_ZONE><REFLECTIVE_LINES>7781</REFLECTIVE_LINES><REFLECTIVE_SAMPLES>7621</REFLECTIVE_SAMPLES><CORNER_UL_PROJECTION_X_PRODUCT>100</CORNER_UL_PROJECTION_X_PRODUCT><CORNER_UL_PROJECTION_Y_PRODUCT>900</CORNER_UL_PROJECTION_Y_PRODUCT><CORNER_UR_PROJECTION_X_PRODUCT>400</CORNER_UR_PROJECTION_X_PRODUCT><CORNER_UR_PROJECTION_Y_PRODUCT>900</CORNER_UR_PROJECTION_Y_PRODUCT><CORNER_LL_PROJECTION_X_PRODUCT>100</CORNER_LL_PROJECTION_X_PRODUCT><CORNER_LL_PROJECTION_Y_PRODUCT>600</CORNER_LL_PROJECTION_Y_PRODUCT><CORNER_LR_PROJECTION_X_PRODUCT>400</CORNER_LR_PROJECTION_X_PRODUCT><CORNER_LR_PROJECTION_Y_PRODUCT>600</CORNER_LR_PROJECTION_Y_PRODUCT></PROJECTION_ATTRIBUTES>
<LEVEL1_PROJECTION_PARAMETERS><GRID_CELL_SIZE_REFLECTIVE>30.0</GRID_CELL_SIZE_REFLECTIVE></LEVEL1_PROJECTION_PARAMETERS>
<LEVEL1_RADIOMETRIC_RESCALING><RADIANCE_MULT_BAND_1>0.0125</RADIANCE_MULT_BAND_1><RADIANCE_ADD_BAND_1>-62.3</RADIANCE_ADD_BAND_1><RADIANCE_MULT_BAND_2>NULL</RADIANCE_MULT_BAND_2></LEVEL1_RADIOMETRIC_RESCALING></LANDSAT_METADATA_FILE>"""


def test_landsat_xml(spark):
    d = spark.createDataFrame([("s", XML)], "scene string, value string")
    r = metadata.landsat_fields(d).collect()[0]
    assert r.item_id == "LC08_L2SP_017036_20130419_02_T2" and r.satellite == 8 and r.sun_azimuth == 319.5 and r.off_nadir == 0.25
    assert r.wrs_path == "017" and r.sr_shape == [7781, 7621] and r.thermal_shape is None and r.proj_bbox == [85.0, 585.0, 415.0, 915.0]
    assert r.scene_datetime == dt.datetime(2013, 4, 19, 16, 6, 1, 515000)
    k = metadata.radiance_constants(d, ["scene"]).collect()
    assert [(x.band, x.mult, x["add"]) for x in k] == [("B1", 0.0125, -62.3)]


def test_names(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(metadata.band_of_image(F.lit("iw-vh.tiff"))) == "vh" and one(metadata.band_of_image(F.lit("s1a-iw-grd-vv-2020.tif"))) == "vv"
    with pytest.raises(Exception, match="not an image"):
        one(metadata.band_of_image(F.lit("iw-vh.png")))
    s = one(metadata.item_sensor(F.lit("LC08_L2SP_017036_20130419_02_T2")))
    assert (s.sensor, s.satellite, s.level, s.correction) == ("oli-tirs", 8, "2", "SP")
    ring = one(metadata.safe_footprint(F.lit("1.0,2.0 3.0,4.0")))
    assert [(p.lon, p.lat) for p in ring] == [(2.0, 1.0), (4.0, 3.0)]
    mid = one(metadata.mid_time(F.lit("2020-01-01 00:00:00").cast("timestamp"), F.lit("2020-01-01 00:00:10").cast("timestamp")))
    assert mid == dt.datetime(2020, 1, 1, 0, 0, 5)
    assert one(metadata.asset_key(F.lit("annotation/calibration/noise-s1a-iw-grd-VV-x.xml"), "noise")).startswith("noise-")


def test_angles(spark):
    text = "BAND01_NUM_L1T_LINES = 100\nBAND01_NUM_L1T_SAMPS = 200\nBAND01_L1T_IMAGE_CORNER_LINES = (0.0, 50.0, 100.0, 50.0)\nBAND01_L1T_IMAGE_CORNER_SAMPS = (100.0, 200.0, 100.0, 0.0)"
    d = spark.createDataFrame([(text, [10.0, 20.0, 14.0, 22.0])], "value string, bbox array<double>")
    r = metadata.angle_footprint(metadata.angle_fields(d)).collect()[0]
    assert [(p.lon, p.lat) for p in r.footprint] == [(12.0, 22.0), (14.0, 21.0), (12.0, 20.0), (10.0, 21.0), (12.0, 22.0)]


def test_tile_store(spark, tmp_path):
    rows = [("pekel", "s2", t, dt.date(2020, 1, d), 0, x, x, d * 10 + x) for t in ("t1", "t2") for d in (1, 2, 3) for x in (0, 1)]
    px = spark.createDataFrame(rows, "model string, constellation string, tile_id string, date date, y int, x int, blue int, green int")
    root = str(tmp_path / "masks")
    sinks.write_masks(px, root)
    sinks.write_masks(px.where("date = '2020-01-02'").withColumn("green", F.lit(7)), root)
    d = tables.read_tiles(spark, root, "s2", ["t1"], ["green"], "2020-01-02")
    assert sorted((str(r.date), r.green) for r in d.collect()) == [("2020-01-02", 7), ("2020-01-02", 7), ("2020-01-03", 30), ("2020-01-03", 31)]
    assert "PartitionFilters" in d._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tables.read_tiles(spark, root, "s2", bands=["red"])
    one = tables.revisit_slice(d, ["tile_id"], "date", 1, 2)
    assert {str(r.date) for r in one.collect()} == {"2020-01-03"}


def test_catalogue(spark):
    rows = [("landsat-c2", 0.0, 0.0, 2.0, 2.0, "2020-01-05", 32631, "T1", "a"), ("landsat-c2", 1.0, 1.0, 3.0, 3.0, "2020-01-06", 32631, "T1", "d"), ("landsat-c2", 1.0, 1.0, 3.0, 3.0, "2020-01-07", 32632, "T1", "d"), ("landsat-c2", 1.0, 1.0, 3.0, 3.0, "2020-01-07", 32631, "T2", "d")]
    items = spark.createDataFrame(rows, "collection string, min_x double, min_y double, max_x double, max_y double, datetime string, epsg int, collection_category string, orbit_state string")
    got = tables.search_items(items, "landsat-c2", (1.5, 1.5, 1.6, 1.6), ("2020-01-01", "2020-02-01"))
    assert got.count() == 2
    with pytest.raises(ValueError):
        tables.search_items(items, "landsat-c2", (9, 9, 10, 10), ("2020-01-01", "2020-02-01"))
    with pytest.raises(ValueError):
        tables.search_items(items, "modis", (0, 0, 1, 1), ("2020-01-01", "2020-02-01"))


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"1": {"tile": "a", "spacecraft_id": "s", "datetime": "2020"}, "2": {"tile": "b", "spacecraft_id": "s", "datetime": "2021"}}))
    assert {r.tile for r in tables.read_hand_labels(spark, str(tmp_path / "labels.json")).collect()} == {"a", "b"}
    (tmp_path / "events.json").write_text('{"aoi_id": 1, "datetime": "2020-01-02T00:00:00", "labels": ["ndvi"], "keyed_values": {"m": "0.5"}}\n')
    ev = tables.read_events(spark, str(tmp_path / "events.json"))
    assert tables.keyed_values(ev, "ndvi", "m").collect()[0].value == 0.5 and tables.keyed_values(ev, "x", "m").isEmpty()
    m = spark.createDataFrame([(0, "2020-01-01", 1, 2)], "dataset_index int, timestamp string, i int, j int")
    sinks.write_index_map(m, str(tmp_path / "map"))
    assert tables.read_index_map(spark, str(tmp_path / "map")).collect() == m.collect()
    w = tables.water_list(spark.createDataFrame([(1, "n", "0101")], "area_id long, name string, geom string"), [1])
    assert bytes(w.collect()[0].geom) == b"\x01\x01"


def test_records_and_batches(spark, tmp_path):
    d = spark.createDataFrame([("a", "s2", dt.datetime(2020, 1, 1), 0.5, 10.0)], tables.REVISITS)
    r = sinks.revisit_records(d).collect()[0]
    assert r.time == "1577836800000" and r.measures["cloud_coverage"] == "10.0"
    root = str(tmp_path / "g")
    sinks.write_together({"vertices": d, "edges": d}, root)
    d.write.parquet(f"{root}/vertices/batch=broken")
    assert sinks.read_batches(spark, root, "vertices").count() == 1


def test_response(spark):
    rows = [(1, dt.date(2020, 1, 1), "a", 1.0, "x_1"), (1, dt.date(2020, 1, 1), "a", 9.0, "x_2"), (1, dt.date(2020, 2, 9), "a", 3.0, "x_1"), (1, dt.date(2020, 1, 1), "b", -5.0, "x_9"), (2, dt.date(2020, 1, 1), "a", 4.0, "x_1")]
    ts = spark.createDataFrame(rows, tables.WATER_TS)
    r = water.timeseries_response(ts, 1).collect()[0].series
    assert [(str(p.date), p.area) for p in r["a"]] == [("2020-01-01", 9), ("2020-01-31", 3)] and "b" not in r
    assert water.timeseries_response(ts, 77).isEmpty()
    with pytest.raises(AssertionError):
        water.all_constellations([])


def test_incremental(spark, tmp_path):
    a = spark.createDataFrame([("s", d) for d in (1, 2, 3)], "c string, d int")
    assert {r.d for r in incremental.pending(a, a.where("d < 2"), ["c", "d"]).collect()} == {2, 3}
    assert incremental.pending(a, a, ["c", "d"]).isEmpty() and incremental.pending(a, a, ["c", "d"], overwrite=True).count() == 3
    with pytest.raises(ValueError):
        incremental.chosen(a, spark.createDataFrame([(9,)], "d int"), ["d"])
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "model string, constellation string, tile_id string, date date, y int, x int, v int"
    part = lambda d: spark.createDataFrame([("m", "s2", "t", dt.date(2020, 1, d), 0, 0, d)], schema)

    def go():
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.fill_masks(stream, lambda df: df.withColumn("mask", F.col("v") * 2), lambda df: sinks.write_masks(df, out), ck).awaitTermination()

    part(1).write.parquet(src)
    go()
    part(2).unionByName(part(1)).write.mode("append").parquet(src)
    go()
    go()
    got = sorted((r.date.day, r.mask) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2), (2, 4)]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(1, "a", f"x_{i % 3}", float(i), dt.datetime(2020, 1, 1, 0, i)) for i in range(20)]
    d = spark.createDataFrame(rows, "area_id long, c string, run_id string, area double, time timestamp")
    d.repartition(4).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = incremental.latest_stream(s, ["area_id", "c"]).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("latest").collect() == incremental.latest_stream(d, ["area_id", "c"]).collect()
    w = incremental.windowed(s, "time", "c", "area", "5 minutes", late="1 hour").writeStream.format("memory").queryName("win").outputMode("complete").start()
    w.processAllAvailable()
    w.stop()
    assert sorted(spark.table("win").collect()) == sorted(incremental.windowed(d, "time", "c", "area", "5 minutes").collect())
    assert incremental.windowed(d, "time", "c", "area", "10 minutes", "5 minutes").count() == 5
    assert incremental.sessions(d, "time", "c", "3 minutes").count() == 1


def test_items(spark):
    from tarn.sources import items

    d = spark.createDataFrame([(XML, "s3://b/LC08_x_MTL.xml")], "value string, href string")
    r = items.landsat_items(d).collect()[0]
    assert r.id == "LC08_L2SP_017036_20130419_02_T2" and r.properties["instruments"] == "oli-tirs" and r.properties["eo:cloud_cover"] == "31.5"
    assert r.assets["SR_B4"] == "s3://b/LC08_x_SR_B4.TIF" and r.assets["ST_B10"].endswith("ST_B10.TIF") and r.assets["ANG"].endswith("_ANG.txt")
    assert "landsat:wrs_type" not in r.properties
    sr = items.landsat_items(d.withColumn("value", F.replace("value", F.lit("<PROCESSING_LEVEL>L2SP"), F.lit("<PROCESSING_LEVEL>L2SR")))).collect()[0]
    assert "ST_B10" not in sr.assets
    old = spark.createDataFrame([({"eo:off_nadir": "0", "a": "1"}, {"B1.TIF": "x", "B2": None})], "properties map<string,string>, assets map<string,string>")
    u = items.upgraded(old).collect()[0]
    assert u.properties == {"a": "1", "view:off_nadir": "0", "constellation": "Landsat"} and u.assets == {"B1": "x"}
    with pytest.raises(Exception, match="off_nadir"):
        items.upgraded(old.withColumn("properties", F.create_map(F.lit("a"), F.lit("1")))).collect()
    with pytest.raises(ValueError):
        items.collection("other")
    one = spark.range(1).select(items.legacy_properties(F.create_map(F.lit("landsat:correction"), F.lit("L2SP"))))
    assert one.collect()[0][0] == {"landsat:processing_level": "L2SP"}


def test_radar(spark):
    from tarn.sources import items

    xml = "<r xmlns:s1sarl1='a' xmlns:s1='b' xmlns:safe='c'><s1sarl1:mode>IW</s1sarl1:mode><s1sarl1:transmitterReceiverPolarisation>VV</s1sarl1:transmitterReceiverPolarisation><s1sarl1:transmitterReceiverPolarisation>VH</s1sarl1:transmitterReceiverPolarisation><s1:pass>DESCENDING</s1:pass><safe:orbitNumber>42</safe:orbitNumber><numberOfSamples>10</numberOfSamples><numberOfLines>20</numberOfLines></r>"
    r = items.radar_fields(spark.createDataFrame([(xml,)], "value string")).collect()[0]
    assert r["mode"] == "IW" and r.polarisations == ["VV", "VH"] and r.orbit_state == "descending" and r.absolute_orbit == 42 and r["shape"] == [10, 20]


def test_geometry_fallback(spark):
    from tarn.sources import items

    i = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    g = lambda rows: spark.createDataFrame(rows, "id string, geometry string")
    got = {r.id: r.geometry for r in items.with_geometry(i, g([("a", "s")]), g([("a", "v"), ("b", "v"), ("c", "v"), ("c", "w")])).collect()}
    assert got == {"a": "s", "b": "v", "c": None}


def test_definitions(spark, tmp_path):
    import json

    from tarn.sources import scenes

    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(content))

    put("common/common-assets.json", {"mtl.xml": {"title": "m", "type": "XML", "description": "of Level-X", "href_suffix": "MTL.xml"}, "ang": {"title": "a", "type": "TEXT", "href_suffix": "ANG.txt"}})
    put("oli_tirs/sr-assets.json", {"qa_pixel": {"title": "q", "roles": ["cloud"]}, "red": {"title": "Red (B4)", "href_suffix": "SR_B4.TIF"}})
    put("oli_tirs/sr-eo-bands.json", {"red": {"name": "OLI_B4", "common_name": "red", "center_wavelength": 0.65}})
    put("oli_tirs/sr-raster-bands.json", {"red": {"unit": "u", "scale": 0.5, "nodata": 0}})
    put("mss/sr-assets.json", {"green": {"title": "Green (B1), satellites 4-5", "href_suffix": "B1.TIF"}})
    put("mss/sr-raster-bands.json", {"green": {"temp_name": "B1", "unit": "u"}})
    defs = scenes.read_definitions(spark, str(tmp_path))
    assert defs.where("sensor = 'oli-tirs'").count() == 4 and defs.where("sensor = 'tm'").count() == 2
    d = spark.createDataFrame([(XML, "s3://b/LC08_x_MTL.xml")], "value string, href string")
    r = scenes.scene_items(d, defs).collect()[0]
    assert scenes.scene_items(d, defs).select(F.map_keys("assets")).collect()[0][0] == ["mtl.xml", "ang", "qa_pixel", "red"]
    assert r.assets["qa_pixel"].href == "s3://b/LC08_x_QA_PIXEL.TIF" and r.assets["qa_pixel"].type == scenes.COG
    assert r.assets["mtl.xml"].description == "of Level-2" and r.assets["mtl.xml"].type == "application/xml"
    red = r.assets["red"]
    assert red.band.name == "OLI_B4" and red.raster.scale == 0.5 and red.raster.unit == "u" and red.gsd is None and r.assets["ang"].raster is None
    assert r.via[1].endswith("/landsat-c2l2-st/items/LC08_L2SP_017036_20130419_20200913_02_T2_ST") and r.epsg == 32617 and r.doi == "10.5066/P9OGBGM6"
    scanner = lambda satellite: d.withColumn("value", F.replace("value", F.lit("LC08_L2SP"), F.lit(f"LM0{satellite}_L1TP")))
    late, early = (scenes.scene_items(scanner(n), defs).collect()[0].assets["green"] for n in (4, 2))
    assert late.raster.scale == 0.0125 and late.raster.offset == -62.3 and late.raster.unit == "u" and late.href.endswith("x_B1.TIF")
    assert early.raster.scale is None and early.raster.unit is None and early.href.endswith("x_B4.TIF") and early.title == "Green (B4), satellites 1-3"
    put("landsat-c2-l1.json", {"title": "T", "license": "L", "keywords": ["k"], "extent": {"spatial": 1}, "links": [{"rel": "about", "href": "h"}], "item_assets": {"a": {"type": "XML", "title": "t"}}})
    c = scenes.read_collection(spark, str(tmp_path), "landsat-c2-l1").collect()[0]
    assert c.id == "landsat-c2-l1" and c.links[0].href == "h" and c.item_assets["a"].type == "application/xml" and json.loads(c.extent) == {"spatial": 1}
    with pytest.raises(ValueError):
        scenes.read_collection(spark, str(tmp_path), "other")


def test_legacy_items(spark):
    from tarn.sources import scenes

    d = spark.createDataFrame([(XML, "s3://b/LC08_x_MTL.xml")], "value string, href string")
    new, old = (scenes.legacy_items(d, legacy=k).collect()[0] for k in (False, True))
    assert new.alternate.endswith("/2013/017/036/LC08_L2SP_017036_20130419_20200913_02_T2") and old.alternate.endswith("/LC08_L2SP_017036_20130419_02_T2")
    a = new.assets
    assert len(a) == 25 and a["SR_B4"].band.common_name == "red" and a["SR_B4"].gsd == 30.0 and a["SR_B4"].proj_shape == [7781, 7621]
    assert a["ST_B10"].gsd == 100.0 and a["ST_QA"].band is None and a["ST_QA"].proj_shape is None and a["ANG"].gsd is None and new.off_nadir is None


def test_radar_items(spark):
    from tarn.sources import scenes

    xml = "<m xmlns:safe='a' xmlns:gml='b'><safe:startTime>2020-01-01T00:00:00.000000</safe:startTime><safe:stopTime>2020-01-01T00:00:10.000000</safe:stopTime><gml:coordinates>1,2 3,4 5,6</gml:coordinates></m>"
    base = "s3://b/S1A_X.SAFE/"
    names = ["annotation/s1a-iw-grd-vh-1.xml", "annotation/calibration/noise-s1a-iw-grd-vh-1.xml", "annotation/calibration/calibration-s1a-iw-grd-vh-1.xml", "measurement/s1a-iw-grd-vh-1.tiff", "preview/x.html"]
    rows = lambda more: spark.createDataFrame([(xml, "<a/>", base + "manifest.safe", [base + n for n in names + more])], "value string, annotation string, href string, files array<string>")
    r = scenes.radar_items(rows([])).collect()[0]
    assert set(r.assets) == {"safe-manifest", "product-vh", "noise-vh", "calibration-vh", "thumbnail", "vh"} and r.id == "S1A_X" and r.bbox == [2.0, 1.0, 6.0, 5.0]
    assert r.datetime == dt.datetime(2020, 1, 1, 0, 0, 5) and r.assets["vh"].title == "VH - 10m" and r.proj_shape == [None, None]
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        scenes.radar_items(rows(["measurement/iw-vh.tiff"])).collect()
