"""Frame, pixel, metric and sampling queries."""

from pyspark.sql import functions as F

from tarn.functions import pixel
from tarn.operators import aggregate, chips, metrics, rules
from tarn.operators import frames as fr
from tarn.queries.base import FRAMES, frames, query


def mask(t):
    return frames(t).withColumn("mask", (F.col("v") > 0).cast("int"))


@query(FRAMES + " SELECT vec_id, CAST(count(*) FILTER (v > 0) * 100 AS BIGINT) AS area FROM f GROUP BY vec_id")
def frame_area(t, spark):
    return aggregate.area(mask(t), ["vec_id"], "mask", "meter", 10)


@query(FRAMES + " SELECT label, round(avg(m), 5) AS stat FROM (SELECT vec_id, avg(CAST(v AS DOUBLE)) AS m FROM f GROUP BY vec_id) JOIN embeddings USING (vec_id) GROUP BY label")
def stat_per_band(t, spark):
    d = frames(t).join(t("embeddings").select("vec_id", "label"), "vec_id").withColumn("v", F.col("v").cast("double"))
    return aggregate.stat_per_band(d, ["label"], ["vec_id"], "v", "mean").select("label", F.round("stat", 5).alias("stat"))


@query(FRAMES + " SELECT y, x, round(median(CAST(v AS DOUBLE)), 6) AS value FROM f GROUP BY y, x")
def temporal_median(t, spark):
    return aggregate.composite(frames(t).withColumn("v", F.col("v").cast("double")), ["y", "x"], "v").select("y", "x", F.round("value", 6).alias("value"))


@query(FRAMES + " SELECT y, x, round(quantile_disc(CAST(v AS DOUBLE), 0.5), 6) AS value FROM f GROUP BY y, x")
def lower_median(t, spark):
    return aggregate.composite(frames(t).withColumn("v", F.col("v").cast("double")), ["y", "x"], "v", "lower_median").select("y", "x", F.round("value", 6).alias("value"))


@query(FRAMES + " SELECT y, x, round(min(CAST(v AS DOUBLE)), 6) AS value FROM f GROUP BY y, x")
def temporal_minimum(t, spark):
    return aggregate.composite(frames(t).withColumn("v", F.col("v").cast("double")), ["y", "x"], "v", "min").select("y", "x", F.round("value", 6).alias("value"))


@query("SELECT o_orderstatus AS status, min(o_custkey) AS min_x, min(o_orderkey) AS min_y, max(o_custkey) AS max_x, max(o_orderkey) AS max_y FROM orders GROUP BY 1")
def extents(t, spark):
    return aggregate.extent(t("orders").withColumnRenamed("o_orderstatus", "status"), ["status"], "o_custkey", "o_orderkey")


@query(FRAMES + " SELECT vec_id, y, x FROM f WHERE vec_id IN (SELECT vec_id FROM f GROUP BY vec_id HAVING count(*) FILTER (v > 0) / count(*) >= 0.5)")
def filled_chips(t, spark):
    return aggregate.keep_filled(mask(t), ["vec_id"], ["mask"], 0.5).select("vec_id", "y", "x")


@query(FRAMES + """, p AS (SELECT vec_id, quantile_cont(CAST(v AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.98) AS hi FROM f GROUP BY vec_id)
SELECT vec_id, y, x, round(least(greatest((v - lo) / nullif(hi - lo, 0), 0), 1), 5) AS stretched FROM f JOIN p USING (vec_id)""")
def percentile_stretch(t, spark):
    d = aggregate.percentile_stretch(frames(t).withColumn("v", F.col("v").cast("double")), ["vec_id"], "v")
    return d.select("vec_id", "y", "x", F.round("stretched", 5).alias("stretched"))


@query("""SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders""")
def describe(t, spark):
    d = aggregate.describe(t("orders"), "o_totalprice")
    return d.select("count", *(F.round(c, 4).alias(c) if c not in ("min", "max") else F.col(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


@query("SELECT o_orderpriority AS params, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1 ORDER BY avg(o_totalprice), 1 LIMIT 1")
def best_parameters(t, spark):
    return aggregate.best_group(t("orders").withColumnRenamed("o_orderpriority", "params"), ["params"], "o_totalprice").select("params", F.round("score", 4).alias("score"))


PAIR = "WITH l AS (SELECT CAST(quality AS BIGINT) AS a, CAST(toxic AS BIGINT) AS b FROM labels)"


def labels(t):
    return t("labels").select(F.col("quality").cast("long").alias("a"), F.col("toxic").cast("long").alias("b"))


@query(PAIR + """ SELECT round(sum(a * b) / sum(a), 6) AS precision, round(sum(a * b) / sum(b), 6) AS recall, round(avg(CAST(a = b AS INTEGER)), 6) AS accuracy,
round(sum(a * b) / (sum(a) + sum(b) - sum(a * b)), 6) AS iou, round(2 * sum(a * b) / (sum(a) + sum(b)), 6) AS dice FROM l""")
def binary_metrics(t, spark):
    d = metrics.evaluate(labels(t), "a", "b", ["precision", "recall", "accuracy", "iou", "dice"])
    return d.select(*(F.round(c, 6).alias(c) for c in d.columns))


CLASSES = "WITH l AS (SELECT label % 4 AS p, CAST(vec_id % 4 AS INTEGER) AS t FROM embeddings), k AS (SELECT DISTINCT p AS c FROM l UNION SELECT DISTINCT t FROM l)"


def classes(t):
    return t("embeddings").select((F.col("label") % 4).alias("p"), (F.col("vec_id") % 4).cast("int").alias("t"))


@query(CLASSES + """ SELECT c AS class, round(sum(CAST(p = c AND t = c AS INTEGER)) / sum(CAST(p = c AS INTEGER)), 6) AS precision, round(sum(CAST(p = c AND t = c AS INTEGER)) / sum(CAST(t = c AS INTEGER)), 6) AS recall,
round(2 * sum(CAST(p = c AND t = c AS INTEGER)) / (sum(CAST(p = c AS INTEGER)) + sum(CAST(t = c AS INTEGER))), 6) AS f1, round(sum(CAST(p = c AND t = c AS INTEGER)) / sum(CAST(p = c OR t = c AS INTEGER)), 6) AS iou FROM l CROSS JOIN k GROUP BY c""")
def multiclass_metrics(t, spark):
    d = metrics.per_class(classes(t), "p", "t")
    return d.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")))


@query(CLASSES + " SELECT t AS truth, p AS pred, count(*) AS n FROM l GROUP BY ALL")
def confusion_matrix(t, spark):
    return metrics.confusion(classes(t), "p", "t")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 6) AS mse, round(avg(abs(l_tax - l_discount)), 6) AS mae FROM lineitem GROUP BY 1")
def regression_metrics(t, spark):
    d = t("lineitem").groupBy("l_returnflag").agg(metrics.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("pearson"), metrics.mse(F.col("l_tax"), F.col("l_discount")).alias("mse"), metrics.mae(F.col("l_tax"), F.col("l_discount")).alias("mae"))
    return d.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("pearson", "mse", "mae")))


@query("""WITH p AS (SELECT user_id AS area_id, event_type AS c, CAST(ts AS DATE) AS date, max(CAST(value > 50 AS INTEGER)) AS m FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
t AS (SELECT user_id AS area_id, event_type AS c, CAST(ts AS DATE) AS date, max(CAST(value > 50 AS INTEGER)) AS m FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT c, round(avg(CAST(p.m = t.m AS INTEGER)), 6) AS accuracy, round(sum(p.m * t.m) / sum(p.m), 6) AS precision FROM p JOIN t USING (area_id, c, date) GROUP BY c""")
def metric_suite(t, spark):
    e = t("events").select(F.col("user_id").alias("area_id"), F.col("event_type").alias("c"), F.to_date("ts").alias("date"), (F.col("value") > 50).cast("int").alias("m"), "event_id")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("area_id", "c", "date").agg(F.max("m").alias("m"))
    d = metrics.suite(side(0), side(1), ["area_id", "c", "date"], "m", ["accuracy", "precision"], ["c"])
    return d.select("c", F.round("accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("precision"))


PIX = "WITH p AS (SELECT vec_id, " + ", ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) + 1) / 2 AS b{i}" for i in range(12)) + " FROM embeddings)"


def pixels(t):
    return t("embeddings").select("vec_id", *(((F.col("embedding")[i].cast("double") + 1) / 2).alias(f"b{i}") for i in range(12)))


@query(PIX + " SELECT vec_id, round((b0 - b1) / nullif(b0 + b1, 0), 6) AS ndvi FROM p")
def ndvi(t, spark):
    return pixels(t).select("vec_id", F.round(pixel.ndvi(F.col("b0"), F.col("b1")), 6).alias("ndvi"))


@query(PIX + """, q AS (SELECT *, greatest(b0, b1, b2) AS v, greatest(b0, b1, b2) - least(b0, b1, b2) AS d FROM p),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN b2 = v THEN 4 + (b0 - b1) / d WHEN b1 = v THEN 2 + (b2 - b0) / d ELSE (b1 - b2) / d END / 6 AS h FROM q)
SELECT vec_id, round((h - floor(h)) * 360, 4) AS hue, round(coalesce(d / nullif(v, 0), 0), 6) AS sat, round(v, 6) AS val FROM h""")
def hsv(t, spark):
    d = pixels(t).select("vec_id", pixel.hsv(F.col("b0"), F.col("b1"), F.col("b2")).alias("h"))
    return d.select("vec_id", F.round("h.hue", 4).alias("hue"), F.round("h.sat", 6).alias("sat"), F.round("h.val", 6).alias("val"))


@query("SELECT l_orderkey, l_linenumber, CAST((l_orderkey % 65536) >> 3 & 1 AS INTEGER) AS cloud, CAST((l_orderkey % 65536) >> 8 & 3 AS INTEGER) AS confidence, ((l_orderkey % 65536) >> 8 & 3) = 3 AS high FROM lineitem")
def quality_bits(t, spark):
    w = (F.col("l_orderkey") % 65536).cast("int")
    return t("lineitem").select("l_orderkey", "l_linenumber", pixel.bits(w, 3).alias("cloud"), pixel.bits(w, 8, 2).alias("confidence"), pixel.high_confidence(w, 8).alias("high"))


@query(PIX + """ SELECT vec_id, CASE WHEN b0 < 0.325 THEN CASE WHEN b2 < 0.166 THEN CASE WHEN b2 < 0.039 THEN 1 ELSE 2 END ELSE CASE WHEN b5 < 0.011 THEN 0 ELSE 4 END END
ELSE CASE WHEN b1 < 0.267 THEN CASE WHEN b4 < 0.674 THEN 4 ELSE 5 END ELSE CASE WHEN b3 < 1.544 THEN 3 ELSE 5 END END END AS class FROM p""")
def decision_tree(t, spark):
    """The first decision tree over six bands of a pixel."""
    d = pixels(t).select("vec_id", *(F.col(f"b{i}").alias(b) for i, b in enumerate(["B03", "B11", "B8A", "B07", "B04", "B10"])))
    return d.select("vec_id", rules.tree_class(rules.TREES["tree1"]).alias("class"))


def _planes(polygons):
    return "(" + " OR ".join("(" + " AND ".join(f"{h.y} {h.op} {h.a!r}::DOUBLE * {h.x} + {h.b!r}::DOUBLE" for h in p) + ")" for p in polygons) + ")"


WATER_SQL = """WITH r AS (SELECT vec_id, embedding[1] + 1.0 AS nir, embedding[2] + 1.0 AS red, embedding[3] + 1.0 AS green, (CAST(embedding[4] AS DOUBLE) + 1) / 4 AS blue,
  (CAST(embedding[5] AS DOUBLE) + 1) / 4 AS swir1, (CAST(embedding[6] AS DOUBLE) + 0.5) / 4 AS swir2 FROM embeddings),
s AS (SELECT vec_id, (CAST(nir AS DOUBLE)) / 8 AS nir, CAST(red AS DOUBLE) / 4 AS red, swir1, swir2 FROM r),
q AS (SELECT *, (nir - red) / nullif(nir + red, 0) AS ndvi, greatest(swir2, nir, red) AS val, greatest(swir2, nir, red) - least(swir2, nir, red) AS d FROM s),
h0 AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN red = val THEN 4 + (swir2 - nir) / d WHEN nir = val THEN 2 + (red - swir2) / d ELSE (nir - red) / d END / 6 AS h FROM q),
h AS (SELECT *, (h - floor(h)) * 360 AS hue FROM h0)
SELECT vec_id, CAST((((val < 0.62 AND """ + _planes(rules.WATER1) + ") OR (val < 0.62 AND " + _planes(rules.WATER2) + ")) <> (swir1 < 0 OR swir2 < 0)) AS TINYINT) AS mask FROM h"


@query(WATER_SQL)
def water_clusters(t, spark):
    """Water clusters by hue and vegetation index, as half-plane polygons."""
    e = F.col("embedding")
    one = lambda i: e[i].cast("double")
    d = t("embeddings").select("vec_id", ((e[0] + F.lit(1.0)).cast("double") / 8).alias("nir"), ((e[1] + F.lit(1.0)).cast("double") / 4).alias("red"), (e[2] + F.lit(1.0)).cast("double").alias("green"), ((one(3) + 1) / 4).alias("blue"), ((one(4) + 1) / 4).alias("swir1"), ((one(5) + 0.5) / 4).alias("swir2"))
    return rules.classify_water(d, "landsat-8", {}).select("vec_id", "mask")


@query(FRAMES + """ SELECT a.vec_id, a.y, a.x, round(CASE WHEN count(*) = 25 THEN avg(CAST(b.v AS DOUBLE)) END, 5) AS mean FROM f a JOIN f b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL""")
def box_mean(t, spark):
    d = chips.box_mean(frames(t).withColumn("v", F.col("v").cast("double")), ["vec_id"], "v")
    return d.select("vec_id", "y", "x", F.round("mean", 5).alias("mean"))


@query(PIX + """ SELECT vec_id, round((b1 / b0) * (b1 / b0 + 3) / ((b1 / b0 + 1) * (b1 / b0 + 1)) * CASE WHEN b0 > b1 AND 10 * log10(b0) >= -17 THEN 1 ELSE 0 END, 6) AS dprvic FROM p""")
def radar_index(t, spark):
    return pixels(t).select("vec_id", F.round(pixel.dprvic(F.col("b0"), F.col("b1")), 6).alias("dprvic"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class FROM embeddings")
def class_of_scores(t, spark):
    return t("embeddings").select("vec_id", pixel.argmax(F.col("embedding")).alias("class"))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - 2846.159579344525) / 1081.0526680766202, 6) AS z FROM lineitem")
def standardised(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(pixel.standardised(F.col("l_extendedprice"), "sentinel-2", "red"), 6).alias("z"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS label FROM labels")
def masks_to_label(t, spark):
    return t("labels").select("doc_id", pixel.masks_to_label([F.col("quality"), F.col("toxic")]).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, round((2e-5 * l_quantity + 0.1) / sin(radians(30 + l_linenumber)), 8) AS reflectance,
round(1321.0789 / ln(774.8853 / (3.3e-4 * l_quantity + 0.1) + 1), 6) AS kelvin FROM lineitem""")
def top_of_atmosphere(t, spark):
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(pixel.reflectance(q, F.lit(2e-5), F.lit(0.1), 30 + F.col("l_linenumber")), 8).alias("reflectance"), F.round(pixel.brightness_temperature(q, F.lit(3.3e-4), F.lit(0.1), F.lit(774.8853), F.lit(1321.0789)), 6).alias("kelvin"))


@query(FRAMES + " SELECT vec_id, CAST(y // 3 AS INTEGER) AS chip_i, CAST(x // 3 AS INTEGER) AS chip_j, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 5) AS s FROM f GROUP BY ALL")
def chip_sums(t, spark):
    d = chips.to_chips(frames(t).withColumn("v", F.col("v").cast("double")), 3)
    return d.groupBy("vec_id", "chip_i", "chip_j").agg(F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("s"))


@query(FRAMES + """, g AS (SELECT vec_id, CAST(unnest(generate_series(0, 8)) AS INTEGER) AS y FROM embeddings), h AS (SELECT vec_id, y, CAST(unnest(generate_series(0, 8)) AS INTEGER) AS x FROM g)
SELECT vec_id, y, x, round(coalesce(CAST(v AS DOUBLE), 0), 6) AS v FROM h LEFT JOIN f USING (vec_id, y, x)""")
def padded_frames(t, spark):
    d = chips.pad(frames(t).withColumn("v", F.col("v").cast("double")), ["vec_id"], 8, 8, 3, "v")
    return d.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(FRAMES + ", g AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM generate_series(0, 3) s(a), generate_series(0, 3) r(b)) SELECT vec_id, g.y, g.x, round(CAST(v AS DOUBLE), 6) AS v FROM g JOIN f ON f.y = g.y * 2 + 1 AND f.x = g.x * 2 + 1")
def nearest_resize(t, spark):
    d = chips.nearest(frames(t).withColumn("v", F.col("v").cast("double")), ["vec_id"], 8, 4, "v")
    return d.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(FRAMES + """, g AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM generate_series(0, 3) s(a), generate_series(0, 3) r(b))
SELECT vec_id, g.y, g.x, round(avg(CAST(v AS DOUBLE)), 5) AS v FROM g JOIN f ON f.y // 2 = g.y AND f.x // 2 = g.x GROUP BY ALL""")
def bilinear_resize(t, spark):
    """Halving: each target is the mean of four."""
    d = chips.bilinear(frames(t).withColumn("v", F.col("v").cast("double")), ["vec_id"], 8, 4, "v")
    return d.select("vec_id", "y", "x", F.round("v", 5).alias("v"))


@query("SELECT vec_id, CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j FROM embeddings, generate_series(0, 3, 3) s(a), generate_series(0, 3, 3) r(b)")
def chip_index(t, spark):
    d = t("embeddings").select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"))
    return chips.chip_index(d, "h", "w", 3, ["vec_id"])


@query("SELECT vec_id, a AS i, b AS j FROM embeddings, (SELECT unnest([0, 3, 5]) AS a), (SELECT unnest([0, 3, 5]) AS b)")
def grid_sampler(t, spark):
    return chips.grid_sampler(t("embeddings").select("vec_id"), 8, 3, 3)


@query(FRAMES + """, k AS (SELECT vec_id % 32 AS xloc, vec_id // 32 AS yloc, y, x, v FROM f)
SELECT CAST(((SELECT max(yloc) FROM k) - yloc) * 8 + y AS BIGINT) AS gy, CAST(xloc * 8 + x AS BIGINT) AS gx, round(CAST(v AS DOUBLE), 6) AS v FROM k""")
def mosaic(t, spark):
    """All frames as one mosaic, 32 in a row."""
    f = frames(t).withColumnRenamed("vec_id", "tile_id")
    tiles = t("embeddings").select(F.col("vec_id").alias("tile_id"), (F.col("vec_id") % 32).alias("xloc"), F.floor(F.col("vec_id") / 32).alias("yloc"))
    return chips.mosaic(f, tiles, 8).select("gy", "gx", F.round(F.col("v").cast("double"), 6).alias("v"))


def _grown(new: str, old: str, edge: str, test: str) -> str:
    """A 3 x 3 dilation or erosion of a table of all pixels; beyond the frame is ``edge``."""
    return f"""{new} AS (SELECT a.vec_id, a.y, a.x, {test}(b.m) {edge} AS m FROM {old} a JOIN {old} b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)"""


def _large(new: str, old: str, wanted: str, limit: int) -> str:
    """Pixels of ``old`` that are ``wanted``, with their component and its size, by reaching out from every pixel."""
    return f"""{new}_r(vec_id, y, x, c) AS (SELECT vec_id, y, x, y * 8 + x FROM {old} WHERE {wanted}
  UNION SELECT b.vec_id, b.y, b.x, r.c FROM {new}_r r JOIN {old} b ON r.vec_id = b.vec_id AND abs(r.y - b.y) <= 1 AND abs(r.x - b.x) <= 1 WHERE {wanted.replace('m', 'b.m')}),
{new} AS (SELECT vec_id, y, x, min(c) AS c FROM {new}_r GROUP BY ALL HAVING count(*) >= {limit})"""


def cleaned_sql(mask: str, limit: int) -> str:
    """Tables up to ``k``, the pixels (vec_id, y, x, c) of the cleaned components of ``p`` (all pixels with m)."""
    return f"""WITH RECURSIVE {mask}, {_grown('d', 'p', '', 'bool_or')}, {_grown('e', 'd', '', 'bool_and')}, {_large('g', 'e', 'NOT m', limit)},
h AS (SELECT vec_id, y, x, e.m OR g.c IS NULL AS m FROM e LEFT JOIN g USING (vec_id, y, x)), {_large('k', 'h', 'm', limit)}"""


MASK = FRAMES.removeprefix("WITH ") + ", p AS (SELECT vec_id, y, x, v > 0 AS m FROM f)"


@query(cleaned_sql(MASK, 3) + """ SELECT vec_id, CAST(count(k.c) AS DOUBLE) AS area FROM (SELECT DISTINCT vec_id FROM f) LEFT JOIN
  (SELECT vec_id, c FROM k WHERE (vec_id, c) IN (SELECT vec_id, c FROM k WHERE y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4)) k USING (vec_id) GROUP BY vec_id""")
def component_area(t, spark):
    """Pixels of cleaned components of each frame that touch its middle."""
    d = mask(t).withColumn("mid", (F.col("y").between(3, 4) & F.col("x").between(3, 4)).cast("int"))
    return fr.cleaned_area(d, ["vec_id"], "mask", "mid", 1, 3)


COLOUR = """, q AS (SELECT *, (nir - red) / nullif(nir + red, 0) AS ndvi, greatest(swir2, nir, red) AS val, greatest(swir2, nir, red) - least(swir2, nir, red) AS d1,
  greatest(nir, green, blue) AS val2, greatest(nir, green, blue) - least(nir, green, blue) AS d2 FROM s),
h0 AS (SELECT *, CASE WHEN d1 = 0 THEN 0 WHEN red = val THEN 4 + (swir2 - nir) / d1 WHEN nir = val THEN 2 + (red - swir2) / d1 ELSE (nir - red) / d1 END / 6 AS h1,
  CASE WHEN d2 = 0 THEN 0 WHEN blue = val2 THEN 4 + (nir - green) / d2 WHEN green = val2 THEN 2 + (blue - nir) / d2 ELSE (green - blue) / d2 END / 6 AS h2 FROM q),
b AS (SELECT *, (h1 - floor(h1)) * 360 AS hue, coalesce(d1 / nullif(val, 0), 0) AS sat, (h2 - floor(h2)) * 360 AS hue2, coalesce(d2 / nullif(val2, 0), 0) AS sat2 FROM h0)"""


def mask_sql() -> str:
    """The mask over ``b``, as text; confusion 6 without a thermal band, 2d by its hue."""
    p = {k: _planes(v) for k, v in (rules.BUILT_IN | rules.OPTIONAL).items()} | {"confusion2d": f"hue2 > {rules.HUE2_2D}", "confusion6": "hue > -100"}
    water = f"((val < {rules.WATER_VAL} AND {_planes(rules.WATER1)}) OR (val < {rules.WATER_VAL} AND {_planes(rules.WATER2)})) <> (swir1 < 0 OR swir2 < 0)"
    groups = [("1a", "1b"), ("2a", "2b", "2c", "2d"), ("3a", "3b", "4a", "4b")]
    tests = ["(" + " OR ".join(f"coalesce({p['confusion' + g]}, FALSE)" for g in group) + ")" for group in groups]
    return " AND ".join([f"coalesce({water}, FALSE)", *tests, f"(coalesce({p['confusion6']}, FALSE) OR coalesce({p['clouds']}, FALSE))"])


PX = """, s AS (SELECT vec_id, y, x, (CAST(v AS DOUBLE) + 1) / 8 AS nir, (CAST(v AS DOUBLE) + 1) / 4 AS red, CAST(v AS DOUBLE) + 1 AS green, (CAST(v AS DOUBLE) + 1) / 4 AS blue,
  (CAST(v AS DOUBLE) + 1) / 4 AS swir1, (CAST(v AS DOUBLE) + 0.5) / 4 AS swir2 FROM f)"""


@query(cleaned_sql(FRAMES.removeprefix("WITH ") + PX + COLOUR + f", p AS (SELECT vec_id, y, x, {mask_sql()} AS m FROM b)", 2)
       + """ SELECT vec_id AS area_id, 'landsat-8' AS constellation, DATE '2020-01-01' AS date, count(k.c) * 900.0::DOUBLE AS area FROM (SELECT DISTINCT vec_id FROM f) LEFT JOIN k USING (vec_id) GROUP BY vec_id""")
def water_area_series(t, spark):
    """Imagery to area series: classify pixels, clean frames, sum."""
    from tarn.plans.water import area_series

    f = frames(t)
    v = F.col("v").cast("double")
    px = f.select(F.col("vec_id").alias("area_id"), F.lit("2020-01-01").cast("date").alias("date"), "y", "x", ((v + 1) / 8).alias("nir"), ((v + 1) / 4).alias("red"), (v + 1).alias("green"), ((v + 1) / 4).alias("blue"), ((v + 1) / 4).alias("swir1"), ((v + 0.5) / 4).alias("swir2"))
    return area_series(px, "landsat-8", 30.0, limit=2)


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v > 0)) AS INTEGER) AS n FROM embeddings")
def scored_chips(t, spark):
    """A pluggable scorer over chips (here a threshold) and its count of class 1."""
    d = fr.scored(t("embeddings"), lambda batch: [(v > 0).astype(int) for v in batch], ["vec_id"], "embedding")
    return d.select("vec_id", F.size(F.filter("classes", lambda c: c == 1)).alias("n"))


def _digest(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


@query(f"""WITH h AS (SELECT vec_id, {_digest('vec_id', '7')} AS h FROM embeddings), r AS (SELECT vec_id, row_number() OVER (ORDER BY h % 4096, h, vec_id) - 1 AS r FROM h),
d AS (SELECT a AS draw, {_digest('a', '9')} % (SELECT count(*) FROM embeddings) AS r FROM generate_series(0, 63) s(a))
SELECT draw, vec_id, CAST(k AS INTEGER) AS k, CAST({_digest('draw', 'k', '10')} % 6 AS INTEGER) AS i, CAST({_digest('draw', 'k', '11')} % 6 AS INTEGER) AS j FROM d JOIN r USING (r), generate_series(0, 3) g(k)""")
def random_sampler(t, spark):
    """Frames drawn with replacement and random chip offsets, the same at every run."""
    return chips.random_sampler(t("embeddings").select("vec_id"), 8, 3, 64, 4, 7)


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 3 AS vv, l_discount AS vh FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest(CASE WHEN vv < 80 THEN vv ELSE 3 * vv END / 2000, 0), 1), 9) AS r,
round(least(greatest(CASE WHEN vv < 80 THEN 8 * vv ELSE 1.1 * vv + 8.75 * vh END / 2000, 0), 1), 9) AS g, round(least(greatest(CASE WHEN vv < 80 THEN 0.5 + 3 * vv + 2000 * vh ELSE 1.75 * vh END / 2000, 0), 1), 9) AS b FROM p""")
def false_colour(t, spark):
    d = t("lineitem").select("l_orderkey", "l_linenumber", pixel.false_colour(F.col("l_quantity") * 3, F.col("l_discount")).alias("c"))
    return d.select("l_orderkey", "l_linenumber", *(F.round(f"c.{k}", 9).alias(k) for k in "rgb"))


@query(FRAMES + """ SELECT vec_id, y, x, round((CAST(v AS DOUBLE) - min(CAST(v AS DOUBLE)) OVER w) / (max(CAST(v AS DOUBLE)) OVER w - min(CAST(v AS DOUBLE)) OVER w + 1e-6), 5) AS u FROM f WINDOW w AS (PARTITION BY vec_id)""")
def min_max_normalised(t, spark):
    from pyspark.sql import Window

    w, v = Window.partitionBy("vec_id"), F.col("v").cast("double")
    d = frames(t)
    return d.select("vec_id", "y", "x", F.round(pixel.min_max(v, F.min(v).over(w), F.max(v).over(w)), 5).alias("u"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_suppkey % 10 <> 0 THEN (l_suppkey % 10) * 2.75e-5 - 0.2 END, 8) AS sr FROM lineitem")
def surface_reflectance(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(pixel.surface_reflectance(F.col("l_suppkey") % 10), 8).alias("sr"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem WHERE l_discount <> 0")
def finite_rows(t, spark):
    """Infinite and undefined ratios become null and their rows go."""
    d = t("lineitem").withColumn("ratio", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount")))
    return d.withColumn("ratio", pixel.finite(F.col("ratio"))).dropna(subset=["ratio"]).select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"))
