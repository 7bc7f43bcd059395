import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn import dims
from tarn.functions import pixel
from tarn.operators import aggregate, align, chips, frames, geo, graph, metrics, rules, timeseries
from tarn.plans import models, water

SEG = [[[0, 0, 0, 1], [0, 1, 1, 1], [0, 0, 1, 1]], [[0, 0, 0, 0], [0, 1, 0, 1], [0, 0, 1, 1]]]


def long(spark, cube):
    rows = [(t, y, x, int(v)) for t, f in enumerate(cube) for y, r in enumerate(f) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "t int, y int, x int, mask int")


@pytest.mark.parametrize(("unit", "resolution", "want"), [("pixel", 1, [6, 4]), ("meter", 10, [600, 400]), ("meter", 20, [2400, 1600]), ("meter", 0.5, [1.5, 1.0])])
def test_area(spark, unit, resolution, want):
    got = aggregate.area(long(spark, SEG), ["t"], "mask", unit, resolution).orderBy("t").collect()
    assert [r.area for r in got] == want


def test_area_guards(spark):
    with pytest.raises(AssertionError):
        aggregate.area(long(spark, SEG), ["t"], unit="feet")
    with pytest.raises(AssertionError):
        aggregate.area(long(spark, SEG), ["t"], unit="meter", resolution=None)


def test_pearson(spark):
    d = spark.createDataFrame(list(zip([6.0, 10.0, 2.0, 1.0, 56.0], [62.0, 108.0, 23.0, 11.0, 568.0], strict=True)), "a double, b double")
    assert metrics.evaluate(d, "a", "b", ["pearson"]).collect()[0][0] == pytest.approx(0.99994690, abs=1e-7)


def test_metrics_guards(spark):
    d = long(spark, SEG)
    with pytest.raises(ValueError):
        metrics.evaluate(d, "mask", "mask", "iou")
    metrics.same_pixels(d, d, ["t", "y", "x"])
    with pytest.raises(AssertionError):
        metrics.same_pixels(d, d.where("x > 0"), ["t", "y", "x"])


def test_r2(spark):
    a, b = np.array([1.0, 2, 3, 5]), np.array([1.5, 2, 2.5, 5])
    d = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double")
    got = metrics.evaluate(d, "a", "b", ["r2", "mse", "mae"]).collect()[0]
    assert got.r2 == pytest.approx(1 - ((b - a) ** 2).sum() / ((b - b.mean()) ** 2).sum()) and got.mse == pytest.approx(((a - b) ** 2).mean()) and got.mae == pytest.approx(np.abs(a - b).mean())


def test_tile_ids(spark):
    t = spark.createDataFrame([(44, "Q", 780000, 2370000, 790000, 2380000, 32644)], "zone int, row string, min_x int, min_y int, max_x int, max_y int, epsg int")
    d = geo.tile_columns(t)
    assert d.collect()[0].tile_id == "44_Q_10000_78_237"
    assert aggregate.same_size(d, "size_x", "size_y") == 10000
    back = geo.tile_from_id(d.select("tile_id")).collect()[0]
    assert (back.min_x, back.min_y, back.max_x, back.max_y, back.epsg) == (780000, 2370000, 790000, 2380000, 32644)
    with pytest.raises(AssertionError):
        aggregate.same_size(geo.tile_columns(t.withColumn("min_y", F.lit(2360000))), "size_x", "size_y")
    with pytest.raises(AssertionError):
        aggregate.same_size(d.limit(0), "size_x", "size_y")
    with pytest.raises(Exception, match="not a tile id"):
        geo.tile_from_id(spark.createDataFrame([("44_Q_10000_78",)], "tile_id string")).collect()


@pytest.mark.parametrize(("lat", "lon", "epsg"), [(60.0, 5.0, 32632), (78.0, 8.0, 32631), (78.0, 10.0, 32633), (78.0, 25.0, 32635), (78.0, 40.0, 32637), (0.0, 3.0, 32731), (10.0, -155.0, 32605), (-33.9, 18.4, 32734)])
def test_utm(spark, lat, lon, epsg):
    d = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert d.select(geo.utm_epsg(F.col("lat"), F.col("lon"))).collect()[0][0] == epsg


def test_projection_round_trip(spark):
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(-80, 84, 200), rng.uniform(-180, 180, 200)
    zone = np.floor((lon + 180) / 6) + 1
    x, y = geo.to_utm(lat, lon, zone, lat < 0)
    la, lo = geo.from_utm(x, y, zone, lat < 0)
    assert np.abs(la - lat).max() < 1e-8 and np.abs(lo - lon).max() < 1e-7
    # the central meridian at the equator, and a point whose coordinates are published
    x, y = geo.to_utm(np.array([0.0, 43.642561]), np.array([3.0, -79.387143]), np.array([31.0, 17.0]), np.array([False, False]))
    assert x[0] == pytest.approx(500000) and y[0] == pytest.approx(0) and abs(x[1] - 630084) < 2 and abs(y[1] - 4833439) < 2
    d = spark.createDataFrame([(43.642561, -79.387143, 17, False)], "lat double, lon double, zone int, south boolean")
    r = d.select(geo.utm_xy("lat", "lon", "zone", "south").alias("p")).select("p.*", F.lit(17).alias("zone"), F.lit(False).alias("south")).select(geo.utm_lonlat("x", "y", "zone", "south").alias("q")).select("q.*").collect()[0]
    assert r.lat == pytest.approx(43.642561) and r.lon == pytest.approx(-79.387143)


def test_tiles_cover_box(spark):
    d = spark.createDataFrame([(1, 18.4, -34.0, 18.6, -33.9)], "area_id long, min_x double, min_y double, max_x double, max_y double")
    t = geo.tiles_of_boxes(d).collect()
    assert {r.epsg for r in t} == {32734} and all(r.max_x - r.min_x == 10000 for r in t) and 4 <= len(t) <= 12


def test_hsv_by_colorsys(spark):
    import colorsys

    rng = np.random.default_rng(1)
    rows = [tuple(map(float, v)) for v in rng.random((60, 3))] + [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    d = spark.createDataFrame(rows, "r double, g double, b double").select("*", pixel.hsv(F.col("r"), F.col("g"), F.col("b")).alias("h"))
    for row in d.collect():
        h, s, v = colorsys.rgb_to_hsv(row.r, row.g, row.b)
        assert (row.h.hue, row.h.sat, row.h.val) == pytest.approx((h * 360, s, v), abs=1e-9)


def test_ndvi_edges(spark):
    d = spark.createDataFrame([(0.0, 0.0), (0.4, 0.1), (None, 0.1)], "nir double, red double")
    got = [r[0] for r in d.select(pixel.ndvi(F.col("nir"), F.col("red"))).collect()]
    assert got[0] is None and got[1] == pytest.approx(0.6) and got[2] is None


def test_trees_reach_every_leaf(spark):
    """A plain walk over the arrays as oracle, on random pixels."""
    rng = np.random.default_rng(4)
    for name, tree in rules.TREES.items():
        bands = rules.tree_bands(tree)
        rows = [tuple(map(float, v)) for v in rng.choice([0.001, 0.02, 0.05, 0.08, 0.17, 0.2, 0.26, 0.3, 0.33, 0.6, 0.8, 1.5], (300, len(bands)))]
        got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{b} double" for b in bands)).select(rules.tree_class(tree)).collect()]
        for row, g in zip(rows, got, strict=True):
            v, i = dict(zip(bands, row, strict=True)), 0
            while i < len(tree) and tree[i] and "<" in tree[i]:
                kind, a, b, t = rules._TEST.fullmatch(tree[i]).groups()
                x = v[a] if kind == "B" else v[a] - v[b] if kind == "S" else v[a] / v[b]
                i = 2 * i + (2 if x < float(t) else 1)
            leaf = tree[i] if i < len(tree) else None
            assert g == (dims.TREE_LABELS[leaf] if leaf else 0), name


def test_water_mask(spark):
    cols = "nir double, red double, green double, blue double, swir1 double, swir2 double"
    px = [(0.02, 0.05, 0.08, 0.09, 0.01, 0.01), (0.4, 0.05, 0.08, 0.04, 0.2, 0.1), (0.02, 0.05, 0.08, -1.0, 0.01, 0.01), (0.02, 0.05, 0.08, 0.09, -0.01, 0.01)]
    got = [r.mask for r in rules.classify_water(spark.createDataFrame(px, cols), "landsat-8").collect()]
    assert got[1] == 0 and got[2] == -1 and got[0] != got[3]
    sar = spark.createDataFrame([(2**16 - 10, 2**16 - 20), (2**16 - 20, 2**16 - 20)], "vv int, vh int")
    assert [r.mask for r in rules.classify_water(sar, "sentinel-1").collect()] == [0, 1]
    with pytest.raises(ValueError, match="missing"):
        rules.water_mask({"clouds": []})


def test_built_in_polygons(spark):
    count = {r: len(p) for r, p in (rules.BUILT_IN | rules.OPTIONAL).items()}
    assert count == {"confusion1a": 5, "confusion1b": 5, "confusion2a": 8, "confusion2b": 9, "confusion2c": 2, "confusion3a": 6, "confusion3b": 4, "confusion4a": 3, "confusion4b": 2, "clouds": 7, "confusion5a": 14, "confusion5b": 5, "confusion5c": 7}
    rng = np.random.default_rng(2)
    names = ("nir", "red", "green", "blue", "swir1", "swir2", "tirs1")
    px = [tuple(map(float, r)) for r in np.c_[rng.uniform(0.001, 0.4, (4000, 6)) * rng.choice([0.1, 0.3, 1], (4000, 1)), rng.uniform(250, 320, 4000)]]
    d = spark.createDataFrame(px, ", ".join(f"{n} double" for n in names))
    for thermal in (False, True):
        b = rules.water_bands(d, rescale=False)
        got = b.withColumn("got", rules.water_mask(thermal=thermal)).withColumn("alone", rules.water_mask({}, thermal)).collect()
        for r in got:
            ok = lambda name: any(all((r[h.y] < h.a * r[h.x] + h.b) if h.op == "<" else (r[h.y] > h.a * r[h.x] + h.b) for h in p) for p in rules.BUILT_IN[name])  # noqa: B023, E731
            groups = ok("confusion1a") or ok("confusion1b"), ok("confusion2a") or ok("confusion2b") or ok("confusion2c") or r.hue2 > 238, any(map(ok, ("confusion3a", "confusion3b", "confusion4a", "confusion4b"))), not thermal or 264 < r.tirs1 < 310 or ok("clouds")
            assert r.got == int(r.alone == 1 and all(groups))
        assert 0 < sum(r.got for r in got) < sum(r.alone for r in got)


def test_polygon_parameter(spark):
    text = "\n".join(f'{{"rule": "{r}", "polygon": 0, "y": "val", "op": ">", "x": "sat", "a": 0, "b": -1}}' for r in rules.CONFUSIONS)
    poly = rules.load_polygons(text)
    cols = "nir double, red double, green double, blue double, swir1 double, swir2 double, _invalid boolean"
    d = spark.createDataFrame([(0.02, 0.05, 0.08, 0.09, 0.01, 0.01)], cols[: cols.rindex(",")])
    a, b = rules.classify_water(d, "landsat-8").collect()[0].mask, rules.classify_water(d, "landsat-8", poly).collect()[0].mask
    assert a == b
    none = rules.load_polygons(text.replace('"op": ">"', '"op": "<"'))
    assert rules.classify_water(d, "landsat-8", none).collect()[0].mask == 0
    with pytest.raises(ValueError):
        rules.load_polygons([{"rule": "x", "polygon": 0, "y": "a", "op": "=", "x": "b", "a": 0, "b": 0}])


def test_resample_as_pandas(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, first in (("a", dt.date(2020, 1, 5)), ("b", dt.date(2020, 2, 1))):
        days = sorted({0, *rng.integers(0, 400, 25).tolist()} - set(range(100, 200)))
        rows += [(1, first + dt.timedelta(int(d)), k, float(rng.integers(1, 1000)) + 0.7, "r_1") for d in days]
    ts = spark.createDataFrame(rows, "area_id long, date date, constellation string, area double, run_id string")
    got = {(r.constellation, r.date): r.area for r in water.resampled(water.area_points(ts), 30).collect()}
    p = pd.DataFrame(rows, columns=["area_id", "date", "c", "area", "run"])
    p["date"] = pd.to_datetime(p.date)
    want = {(k, d.date()): int(v) for k, g in p.groupby("c") for d, v in g.set_index("date").area.resample("30D").mean().fillna(0).items()}
    assert got == want


def test_latest_run_order(spark):
    rows = [(1, "a", "x_9", 1.0), (1, "a", "x_10", 2.0), (2, "a", "x", 3.0), (2, "a", "x_b", 4.0), (3, "a", "y_1", 5.0), (3, "a", "z_1", 6.0)]
    d = spark.createDataFrame(rows, "area_id long, c string, run_id string, area double")
    got = {r.area_id: r.area for r in timeseries.latest_run(d, ["area_id", "c"]).collect()}
    assert got == {1: 1.0, 2: 4.0, 3: 6.0}


def test_fill_and_interpolate_as_pandas(spark):
    v = [None, None, 1.0, None, None, 4.0, 6.0, None, None]
    d = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    s = pd.Series(v, dtype=float)
    a = [r.f for r in timeseries.forward_fill(d, ["k"], ["i"], "v", "f").orderBy("i").collect()]
    b = [r.f for r in timeseries.interpolate(d, ["k"], ["i"], "v", "f").orderBy("i").collect()]
    assert pd.Series(a, dtype=float).equals(s.ffill()) and np.allclose(pd.Series(b, dtype=float), s.interpolate(), equal_nan=True)


def test_forecast_sums(spark):
    d = timeseries.forecast_sums(spark.createDataFrame([(1.0, 2.0, 3.0, 10.0, 20.0)], "f1 double, f2 double, f3 double, o0 double, o1 double"), ["f1", "f2", "f3"], ["o0", "o1"]).collect()[0]
    assert (d.f1_sum_2, d.f1_sum_3, d.f2_sum_2, d.f2_sum_3, d.f3_sum_3) == (11, 31, 3, 13, 6)


def test_common_dates_and_guard(spark):
    d = spark.createDataFrame([("s", 1, x) for x in (1, 2, 3)] + [("s", 2, x) for x in (2, 3, 5)], "c string, tile int, date int")
    assert sorted(r.date for r in align.common_dates(d, ["c"], "tile", "date").collect()) == [2, 3]
    with pytest.raises(KeyError):
        align.to_label_dates(d, spark.createDataFrame([(9,)], "date int"), ["date"])
    with pytest.raises(ValueError):
        align.where_query(d, {"date": {"near": 3}})
    assert len(align.feature_subsets(["a", "b", "c"])) == 7


def test_paths_keep_order_and_repeats(spark):
    t = spark.createDataFrame([(1,), (1,)], "tile int")
    assert [r.constellation for r in align.tile_paths(t, ["s2", "l8"]).collect()] == ["s2", "l8", "s2", "l8"]


def test_chips_round_trip(spark):
    d = long(spark, SEG)
    back = chips.from_chips(chips.to_chips(d, 2).drop("y", "x"), 2)
    assert sorted(back.select("t", "y", "x", "mask").collect()) == sorted(d.collect())
    assert chips.grid_offsets(8, 3, 3) == [0, 3, 5] and chips.grid_offsets(6, 3, 3) == [0, 3]
    with pytest.raises(ValueError):
        chips.grid_offsets(2, 3, 1)
    assert chips.target_size(100, 10, 30) == pytest.approx(33.333, abs=1e-3) and chips.target_size(100, 30, 10, legacy=True) == 150


@pytest.mark.parametrize(("size", "target"), [(8, 4), (4, 8), (5, 7), (7, 3), (10, 2), (1, 5), (6, 6)])
def test_resized_frames(spark, size, target):
    """Equal to the formula on whole arrays; frames without a key and pixels outside are left out."""
    a = np.arange(2.0 * size * size).reshape(2, size, size) ** 2
    rows = [(k, y, x, float(a[k, y, x])) for k in (0, 1) for y in range(size) for x in range(size)] + [(0, size, 0, 9.0), (1, 0, -1, 9.0), (0, None, 0, 9.0), (None, 0, 0, 9.0)]
    d = spark.createDataFrame(rows, "t int, y int, x int, v double")
    full = lambda df: {(r.t, r.y, r.x): r.v for r in df.collect()}
    at = np.clip((np.arange(target) + 0.5) * size / target - 0.5, 0, size - 1)
    w = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(size)))
    i = np.floor((np.arange(target) + 0.5) * size / target).astype(int)
    for got, want in ((chips.nearest, a[:, i][:, :, i]), (chips.bilinear, w @ a @ w.T)):
        out = got(d, ["t"], size, target, "v")
        found = full(out)
        assert out.count() == len(found) == want.size and all(found[p] == pytest.approx(v) for p, v in np.ndenumerate(want))


def test_frames_are_not_broadcast(spark):
    """The grid of all frames is much larger than the list of frames by which Spark judges it; none of it goes through the driver."""
    n = 500
    d = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")).select("id", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x")).withColumn("v", F.sin(F.col("id") + F.col("y") * 8 + F.col("x")))
    whole = frames.inferred(d, ["id"], "v", 8, 4, 3, lambda batch: [(v > 0).astype(int) for v in batch], 0.01, 0.2)
    for out, rows in ((whole, 64), (chips.bilinear(d, ["id"], 8, 4, "v"), 16), (chips.nearest(d, ["id"], 8, 4, "v"), 16), (chips.pad(d, ["id"], 8, 8, 3, "v"), 81)):
        assert len(out.collect()) == n * rows
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_inferred_pads_missing_chips(spark):
    """Frames of one pixel and of one null: every pixel comes back, absent ones scored as 0 normalised."""
    d = spark.createDataFrame([(1, 0, 0, 8.0), (2, 7, 7, None)], "t int, y int, x int, v double")
    seen = lambda batch: [np.where(v > 0, 1, np.where(v == -3, 2, 3)) for v in batch]
    got = {(r.t, r.y, r.x): r.mask for r in frames.inferred(d, ["t"], "v", 8, 4, 3, seen, 1.5, 0.5).collect()}
    assert got == {(t, y, x): 1 if t == 1 and y < 2 and x < 2 else 2 for t in (1, 2) for y in range(8) for x in range(8)}


def test_mosaic_orders_numbers(spark):
    tiles = spark.createDataFrame([("a", 99, 5), ("b", 100, 5), ("c", 99, 4)], "tile_id string, xloc int, yloc int")
    px = spark.createDataFrame([(t, y, x) for t in "abc" for y in (0, 1) for x in (0, 1)], "tile_id string, y int, x int")
    got = {(r.tile_id, r.y, r.x): (r.gy, r.gx) for r in chips.mosaic(px, tiles, 2).collect()}
    assert got["b", 0, 0] == (0, 2) and got["c", 1, 1] == (3, 1)
    with pytest.raises(ValueError):
        chips.mosaic(px, tiles.withColumn("epsg", F.col("xloc")), 2)


def test_graph(spark):
    v = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0)], "id long, w double")
    e = spark.createDataFrame([(1, 2, "aois"), (1, 3, "aois"), (2, 3, "on")], "src long, dst long, label string")
    assert {r.id for r in graph.out(v, e, v.where("id = 1"), "aois").collect()} == {2, 3}
    assert {r.id: r["mean"] for r in graph.neighbour_mean(v, e, "w").collect()} == {1: 5.0, 2: 4.0, 3: 3.0}
    new = spark.createDataFrame([(1, "tags", "b", 2), (1, "tags", "a", 1), (1, "name", "x", 1), (1, "name", "y", 2)], "id long, name string, value string, at int")
    got = {r.name: r["values"] for r in graph.merge_attributes(v, new, ["tags"], "at").collect()}
    assert got == {"tags": ["a", "b"], "name": ["x"]}
    with pytest.raises(KeyError):
        graph.merge_attributes(v, new.withColumn("id", F.lit(9).cast("long")), [], "at")
    nodes, edges = graph.revisit_rows(spark.createDataFrame([(10, "s2", "a1")], "id long, satellite string, aoi string"))
    assert nodes.count() == 1 and {r.label for r in edges.collect()} == {"captures", "on"}


def test_models(spark):
    with pytest.raises(KeyError):
        models.model("none")
    d = spark.createDataFrame([(0b1100000000,), (0b0100000000,)], "bqa int")
    assert [r.cloud for r in models.model("cloud_mask")(d, constellation="landsat-8").collect()] == [1, 0]
    with pytest.raises(ValueError):
        models.cloud_mask(d, "sentinel-1")
    px = spark.createDataFrame([("d", y, x, 0.5, 0.1) for y in range(6) for x in range(6)], "date string, y int, x int, vv double, vh double")
    got = {(r.y, r.x): r.dprvic for r in models.model("soil_moisture")(px).collect()}
    q = 0.2
    assert got[0, 0] is None and got[2, 2] == pytest.approx(q * (q + 3) / (q + 1) ** 2)


def test_forecast(spark):
    rng = np.random.default_rng(0)
    x = rng.random(200)
    d = spark.createDataFrame([(float(v), float(3 * v)) for v in x], "a double, y double")
    pred, mse = models.forecast(d, d, ["a"], "y", maxIter=10)
    assert mse < 0.05 and pred.count() == 200


def test_dims(spark):
    assert dims.common_names("sentinel-1") == ["VV", "VH"] and dims.family("landsat-7") == "landsat"
    assert dims.band_info(spark).where("constellation = 'sentinel-2'").count() == 13 and dims.resolutions(spark).count() == 4
    with pytest.raises(ValueError):
        dims.common_names("other")
    with pytest.raises(ValueError):
        pixel.standardised(F.lit(1), "landsat-8", "nope")


def test_tile_geometries(spark):
    d = spark.createDataFrame([(1, ["44_Q_10000_78_237", "34_H_10000_26_624"]), (2, ["44_Q_10000_78_238"])], "area_id long, tiles array<string>")
    got = {r.tile_id: r.ring for r in water.tile_geometries(d, 1).collect()}
    assert set(got) == {"44_Q_10000_78_237", "34_H_10000_26_624"}
    ring = got["44_Q_10000_78_237"]
    assert ring[0] == ring[4] and 78 < ring[0].lon < 85 and 21 < ring[0].lat < 22
    assert got["34_H_10000_26_624"][0].lat < 0
    assert water.lookup(d, "area_id", 2).count() == 1 and water.lookup(d, "area_id").count() == 2


def test_worker_share(spark):
    d = spark.range(7)
    assert [r[0] for r in d.select(chips.worker_share(F.col("id"), 7, 3)).collect()] == [0, 1, 2, 0, 1, 2, 0]
    assert [r[0] for r in d.select(chips.worker_share(F.col("id"), 7, 3, strided=False)).collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_random_sampler(spark):
    f = spark.range(40).withColumnRenamed("id", "frame")
    a, b = (chips.random_sampler(f, 100, 10, 16, 3, seed=1) for _ in range(2))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 48
    assert all(0 <= r.i <= 90 and 0 <= r.j <= 90 for r in a.collect())


def test_crop(spark):
    d = long(spark, SEG)
    assert chips.crop(d, 1, 1, 2).where("t = 0").count() == 4


def test_frames_lie_anywhere(spark):
    """Coordinates may be negative or far from 0; components keep them."""
    at = [(-1, -1), (-1, 0), (0, -1), (0, 0), (5, 1_000_000)]
    d = spark.createDataFrame([(1, y, x, 1) for y, x in at[:4]] + [(2, y + 3_000_000, x + 500_000, 1) for y, x in at[:4]], "f int, y int, x int, mask int")
    got = {(r.f, r.y, r.x, r.component) for r in frames.components(d, ["f"], limit=2).collect()}
    assert got == {(1, y, x, 1) for y, x in at[:4]} | {(2, y + 3_000_000, x + 500_000, 1) for y, x in at[:4]}


def test_random_sampler_draws_alike(spark):
    f = spark.range(2000).withColumnRenamed("id", "vec_id")
    draws = chips.random_sampler(f, 8, 3, 1000, 1, 7)
    n = draws.select("vec_id").distinct().count()
    assert draws.count() == 1000 and 730 < n < 840  # 787 are expected with replacement
    assert chips.random_sampler(f.limit(0), 8, 3, 10, 2).count() == 0


def test_describe_ranks_exactly(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(0, 50, 501), np.zeros(40), np.full(60, -3.25), 1e9, -1e-9]
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    r = aggregate.describe(d, "v").collect()[0]
    assert r["count"] == len(v) and [r.q25, r.q50, r.q75] == pytest.approx(np.percentile(v, [25, 50, 75]).tolist())


def test_runs_of_a_model(spark):
    from tarn.plans import water

    d = spark.createDataFrame([("a-c_n-1",), ("a-cxn-1",), ("c_n",), (None,)], "run_id string")
    assert [r.run_id for r in water.of_model(d, "c_n").collect()] == ["a-c_n-1"]
