"""Alignment, set, geography, graph and metadata queries."""

from pyspark.sql import functions as F

from tarn.operators import align, geo, graph
from tarn.queries.base import query
from tarn.sources import metadata, tables

E = "WITH e AS (SELECT event_type AS c, user_id AS tile_id, CAST(ts AS DATE) AS date, value AS v FROM events)"


def ev(t):
    return t("events").select(F.col("event_type").alias("c"), F.col("user_id").alias("tile_id"), F.to_date("ts").alias("date"), F.col("value").alias("v"))


@query(E + """, k AS (SELECT DISTINCT c, tile_id % 5 AS tile_id, date FROM e) SELECT c, date FROM k GROUP BY c, date
HAVING count(*) = (SELECT count(DISTINCT tile_id) FROM k k2 WHERE k2.c = k.c)""")
def common_dates(t, spark):
    """Dates that all tiles of a constellation have."""
    return align.common_dates(ev(t).withColumn("tile_id", F.col("tile_id") % 5), ["c"], "tile_id", "date")


@query(E + """, m AS (SELECT c, tile_id % 3 AS band, date, max(v) AS v FROM e GROUP BY ALL)
SELECT d.date, b.band, k.c, m.v FROM (SELECT DISTINCT date FROM m) d CROSS JOIN (SELECT DISTINCT band FROM m) b CROSS JOIN (SELECT DISTINCT c FROM m) k
LEFT JOIN m ON m.date = d.date AND m.band = b.band AND m.c = k.c""")
def outer_align(t, spark):
    """Every date with every band and constellation; gaps are null."""
    m = ev(t).groupBy("c", (F.col("tile_id") % 3).alias("band"), "date").agg(F.max("v").alias("v"))
    return align.scaffold(m, "date", "band", "c").select("date", "band", "c", "v")


@query("SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM events l WHERE l.event_id % 10 = 0 AND l.user_id = e.user_id AND CAST(l.ts AS DATE) = CAST(e.ts AS DATE))")
def on_label_dates(t, spark):
    e = t("events").withColumn("date", F.to_date("ts"))
    return align.to_label_dates(e, e.where("event_id % 10 = 0"), ["user_id", "date"]).select("event_id", "user_id")


@query(E + """, a AS (SELECT tile_id, date, max(v) AS v FROM e WHERE c = (SELECT min(c) FROM e) GROUP BY ALL), b AS (SELECT tile_id, date, max(v) AS v FROM e WHERE c = (SELECT max(c) FROM e) GROUP BY ALL)
SELECT tile_id, date, a.v AS v_true, b.v AS v_pred FROM a JOIN b USING (tile_id, date)""")
def paired_series(t, spark):
    e = ev(t)
    one = lambda end: e.where(F.col("c") == e.agg(end("c")).scalar()).groupBy("tile_id", "date").agg(F.max("v").alias("v"))
    return align.paired(one(F.min), one(F.max), ["tile_id", "date"], "v")


@query("SELECT o.o_orderkey, o.o_orderstatus, c.c_acctbal, c.c_nationkey FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON o.o_custkey = c.c_custkey")
def feature_left_join(t, spark):
    o = t("orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("k"))
    c = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_nationkey")
    return align.left_features(o, c, ["k"], "_r").drop("k")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def without_test_keys(t, spark):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return align.without(o, t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), ["k"]).select("o_orderkey")


@query("SELECT n_nationkey, c AS constellation FROM nation CROSS JOIN (SELECT unnest(['sentinel-2', 'landsat-8']) AS c)")
def tile_paths(t, spark):
    return align.tile_paths(t("nation").select("n_nationkey"), ["sentinel-2", "landsat-8"])


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_quantity AS DOUBLE) ELSE 0.5 * l_quantity + (l_suppkey % 4) END, 4) AS radiance FROM lineitem""")
def rescaled_bands(t, spark):
    """Constants by band; where there are none the number stays."""
    k = spark.createDataFrame([(b, 0.5, float(b)) for b in (1, 2, 3)], "band long, mult double, add double")
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_suppkey") % 4).alias("band"))
    return align.rescaled(d, k, ["band"], "l_quantity", "radiance").select("l_orderkey", "l_linenumber", F.round("radiance", 4).alias("radiance"))


BOXES = """WITH b AS (SELECT p_partkey AS id, (p_partkey * 37) % 1000 AS min_x, (p_partkey * 91) % 1000 AS min_y, 40 + p_size AS s, CAST(p_partkey % 2 AS INTEGER) AS epsg FROM part)"""


def boxes(t):
    b = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).alias("min_x"), (F.col("p_partkey") * 91 % 1000).alias("min_y"), (40 + F.col("p_size")).alias("s"), (F.col("p_partkey") % 2).cast("int").alias("epsg"))
    return b.withColumns({"max_x": F.col("min_x") + F.col("s"), "max_y": F.col("min_y") + F.col("s")})


@query(BOXES + """ SELECT a.id AS outer_id, i.id AS inner_id FROM (SELECT * FROM b WHERE id % 5 = 0) a JOIN (SELECT * FROM b WHERE id % 5 <> 0) i
ON a.epsg = i.epsg AND a.min_x <= i.min_x AND a.min_y <= i.min_y AND a.min_x + a.s >= i.min_x + i.s AND a.min_y + a.s >= i.min_y + i.s""")
def tile_containment(t, spark):
    """Range join as an equality join on grid cells."""
    b = boxes(t)
    inner = b.where("id % 5 <> 0").select(F.col("id").alias("inner_id"), *(F.col(c).alias(f"p_{c}") for c in ("min_x", "min_y", "max_x", "max_y", "epsg")))
    return align.containing(b.where("id % 5 = 0"), inner, 50).select(F.col("id").alias("outer_id"), "inner_id")


@query(BOXES + " SELECT id FROM b WHERE min_x <= 500 AND min_x + s >= 300 AND min_y <= 420 AND min_y + s >= 200 AND s IN (50, 60, 70) AND epsg >= 1")
def catalogue_search(t, spark):
    items = align.where_query(boxes(t), {"s": {"in": [50, 60, 70]}, "epsg": {"gte": 1}})
    return items.where(align.overlapping((300, 200, 500, 420))).select("id")


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), m AS (SELECT k FROM n ORDER BY n DESC, k LIMIT 1) SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT k FROM m)""")
def modal_filter(t, spark):
    return align.modal_filter(t("customer"), "c_nationkey").select("c_custkey")


D = "WITH d AS (SELECT event_type AS c, CAST(ts AS DATE) AS date, user_id AS u FROM events)"


@query(D + " SELECT date FROM d WHERE u % 2 = 0 INTERSECT SELECT date FROM d WHERE u % 2 = 1")
def dates_intersection(t, spark):
    e = ev(t)
    return e.where("tile_id % 2 = 0").select("date").intersect(e.where("tile_id % 2 = 1").select("date"))


@query(D + " SELECT c, date FROM d WHERE u % 7 = 0 UNION SELECT c, date FROM d WHERE u % 7 <> 0")
def dates_union(t, spark):
    e = ev(t)
    return e.where("tile_id % 7 = 0").select("c", "date").union(e.where("tile_id % 7 <> 0").select("c", "date")).distinct()


@query(D + " SELECT c, date, u FROM d WHERE u % 7 <> 0 EXCEPT SELECT c, date, u + 1 FROM d")
def dates_difference(t, spark):
    """Dates of an area on which its neighbour has none."""
    e = ev(t)
    return e.where("tile_id % 7 <> 0").select("c", "date", F.col("tile_id").alias("u")).subtract(e.select("c", "date", F.col("tile_id") + 1))


@query("SELECT k, max(v) AS v FROM (SELECT o_custkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer) GROUP BY k")
def union_by_maximum(t, spark):
    a = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return align.union_by_maximum(a, t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), ["k"], "v")


@query("WITH b AS (SELECT unnest(generate_series(1, 15)) AS m) SELECT m AS mask, CAST(bit_count(m) AS INTEGER) AS size FROM b")
def feature_subsets(t, spark):
    """All non-empty subsets of four groups, as bit masks."""
    names = ["a", "b", "c", "d"]
    rows = [(sum(1 << names.index(x) for x in s), len(s)) for s in align.feature_subsets(names)]
    return spark.createDataFrame(rows, "mask long, size int")


LATLON = "WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 17000) / 100.0 - 80 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lon FROM customer)"


@query(LATLON + """, z AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 9 THEN 31
WHEN lat >= 72 AND lat < 84 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat >= 72 AND lat < 84 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lat < 84 AND lon >= 33 AND lon < 42 THEN 37
ELSE CAST(trunc((lon + 180) / 6) AS INTEGER) + 1 END AS zone FROM p) SELECT id, zone, CAST(CASE WHEN lat > 0 THEN 32600 ELSE 32700 END + zone AS INTEGER) AS epsg FROM z""")
def utm_epsg(t, spark):
    p = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 17000 / 100.0 - 80).alias("lat"), (F.col("c_custkey") * 104729 % 36000 / 100.0 - 180).alias("lon"))
    return p.select("id", geo.utm_zone(F.col("lat"), F.col("lon")).alias("zone"), geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


@query("""WITH i AS (SELECT c_custkey AS id, (c_custkey % 60 + 1) || '_' || CASE WHEN c_custkey % 2 = 0 THEN 'Q' ELSE 'K' END || '_10000_' || (c_custkey % 90) || '_' || (c_custkey % 900) AS tile_id FROM customer)
SELECT id, CAST(id % 60 + 1 AS INTEGER) AS zone, id % 90 * 10000 AS min_x, id % 900 * 10000 + 10000 AS max_y, CAST(CASE WHEN id % 2 = 0 THEN 32600 ELSE 32700 END + id % 60 + 1 AS INTEGER) AS epsg, tile_id AS again FROM i""")
def tile_ids(t, spark):
    """Ids to bounds and back."""
    k = F.col("c_custkey")
    i = t("customer").select(k.alias("id"), F.concat_ws("_", k % 60 + 1, F.when(k % 2 == 0, "Q").otherwise("K"), F.lit(10000), k % 90, k % 900).alias("tile_id"))
    d = geo.tile_from_id(i).drop("tile_id")
    return geo.tile_columns(d).select("id", "zone", "min_x", "max_y", "epsg", F.col("tile_id").alias("again"))


@query("SELECT r.r_regionkey AS src, CAST(n.n_nationkey AS INTEGER) AS id, n.n_name AS name FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey < 3")
def graph_one_hop(t, spark):
    n = t("nation")
    edges = n.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"), F.lit("aois").alias("label"))
    start = t("region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("id"))
    return graph.out(n.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")), edges, start, "aois").select("src", "id", "name")


@query("SELECT c_nationkey AS id, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def graph_neighbour_mean(t, spark):
    """Mean balance of each nation's neighbours (its customers)."""
    c = t("customer").select((F.col("c_custkey") + 1000).cast("long").alias("id"), "c_acctbal", F.col("c_nationkey").cast("long").alias("nation"))
    v = c.select("id", "c_acctbal").unionByName(t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(None).cast("double").alias("c_acctbal")))
    m = graph.neighbour_mean(v, c.select(F.col("nation").alias("src"), F.col("id").alias("dst")), "c_acctbal")
    return m.where("id < 1000").select(F.col("id").cast("int").alias("id"), F.round("mean", 4).alias("mean"))


@query("""SELECT c_custkey AS id, 's3://sentinel-s1-l1c/GRD/2020/' || (c_custkey % 12 + 1) || '/' || (c_custkey % 28 + 1) || '/IW/DV/S1A_IW_GRDH_1SDV_20200101T0_20200101T1_' || c_custkey || '_X' AS path FROM customer""")
def granule_paths(t, spark):
    k = F.col("c_custkey")
    d = t("customer").select(k.alias("id"), F.concat(F.lit("2020-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00")).alias("date"), F.concat(F.lit("S1A_IW_GRDH_1SDV_20200101T0_20200101T1_"), k.cast("string"), F.lit("_X")).alias("granule"))
    return d.select("id", metadata.granule_path(F.col("date"), F.col("granule"), F.lit("IW"), F.lit("S1A_IWDV_0")).alias("path"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 4 AND c_custkey % 3 < 2 THEN 'B' || (c_custkey % 5 + 4) WHEN c_custkey % 5 < 4 THEN 'B' || (c_custkey % 5 + 1) ELSE 'B9' END AS band FROM customer""")
def renumbered_bands(t, spark):
    k = F.col("c_custkey")
    d = t("customer").select(k.alias("id"), F.when(k % 5 < 4, F.concat(F.lit("B"), (k % 5 + 1).cast("string"))).otherwise("B9").alias("b"), F.when(k % 3 < 2, 2).otherwise(5).alias("sat"))
    return d.select("id", metadata.renumbered_mss(F.col("b"), F.col("sat")).alias("band"))


@query("SELECT user_id AS aoi_id, event_type AS constellation, ts AS time FROM events WHERE value < 20 AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def asset_revisits(t, spark):
    """Asset to its areas to their cloud-free revisits: two semi joins."""
    areas = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return t("events").where("value < 20").join(areas, "user_id", "left_semi").select(F.col("user_id").alias("aoi_id"), F.col("event_type").alias("constellation"), F.col("ts").alias("time"))


@query("SELECT c_custkey AS area_id, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 7, 100)")
def water_list(t, spark):
    w = t("customer").select(F.col("c_custkey").alias("area_id"), F.col("c_name").alias("name"), F.hex("c_name").alias("geom"))
    return tables.water_list(w, [1, 5, 7, 100]).select("area_id", F.col("geom").cast("string").alias("name"))


@query("SELECT event_id FROM (SELECT event_id, dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) - 1 AS n FROM events) WHERE n >= 2 AND n < 5")
def revisit_slice(t, spark):
    e = t("events").withColumn("date", F.to_date("ts"))
    return tables.revisit_slice(e, ["event_type"], "date", 2, 5).select("event_id")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 3 = 0 AND d.user_id = e.user_id AND CAST(d.ts AS DATE) = CAST(e.ts AS DATE))")
def pending_revisits(t, spark):
    """What incremental mask filling still has to do."""
    from tarn.streaming.incremental import pending

    e = t("events").withColumn("date", F.to_date("ts"))
    return pending(e, e.where("event_id % 3 = 0"), ["user_id", "date"]).select("event_id")
