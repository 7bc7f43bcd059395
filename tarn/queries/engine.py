"""Pixel rules, frames, models, samples, evaluation and streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.dims import TREE_LABELS
from tarn.functions import pixel
from tarn.operators import aggregate, chips, frames, metrics, rules
from tarn.plans import models
from tarn.queries import cubes
from tarn.queries.base import FRAMES, query, scratch
from tarn.queries.base import frames as frames_of
from tarn.streaming import incremental

def long_frames(t):
    return frames_of(t).withColumn("v", F.col("v").cast("double"))


# pixels

SIX = """, s AS (SELECT vec_id, """ + ", ".join(f"(CAST(embedding[{i}] AS DOUBLE) + {a}) / {b} AS {n}" for i, (n, a, b) in enumerate((("nir", 1, 8), ("red", 1, 4), ("green", 1, 1), ("blue", 1, 4), ("swir1", 0.5, 4), ("swir2", 0.5, 4)), 1)) + " FROM embeddings)"


def six(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", *(((e[i].cast("double") + a) / b).alias(n) for i, (n, a, b) in enumerate((("nir", 1, 8), ("red", 1, 4), ("green", 1, 1), ("blue", 1, 4), ("swir1", 0.5, 4), ("swir2", 0.5, 4)))))


@query("WITH " + SIX[2:] + cubes.COLOUR + f" SELECT vec_id, CAST({cubes.mask_sql()} AS TINYINT) AS mask FROM b")
def water_mask_full(t, spark):
    """The whole mask: clusters, confusions and clouds."""
    return rules.classify_water(six(t), "landsat-8").select("vec_id", "mask")


RULES = rules.BUILT_IN | rules.OPTIONAL


@query("WITH " + SIX[2:].replace(" FROM emb", ", (CAST(embedding[7] AS DOUBLE) + 1) * 280 AS tirs1 FROM emb") + cubes.COLOUR + " SELECT vec_id, " + ", ".join(f"coalesce({cubes._planes(v)}, FALSE) AS {k}" for k, v in RULES.items()) + " FROM b")
def water_rules(t, spark):
    """Every polygon rule by itself, the unused ones among them."""
    thermal = t("embeddings").select("vec_id", ((F.col("embedding")[6].cast("double") + 1) * 280).alias("tirs1"))
    d = rules.water_bands(six(t).join(thermal, "vec_id"), rescale=False)
    return d.select("vec_id", *(rules.inside(p).alias(k) for k, p in RULES.items()))


def _case(tree: list, i: int = 0) -> str:
    """A tree as SQL: the second child where the test holds, 0 where a branch is missing."""
    node = tree[i] if i < len(tree) else None
    if node is None:
        return "0"
    if "<" not in node:
        return str(TREE_LABELS[node])
    left, limit = node.split("<")
    bands = left[2:-1].split(",")
    value = {"B": lambda: bands[0], "S": lambda: f"({bands[0]} - {bands[1]})", "R": lambda: f"({bands[0]} / nullif({bands[1]}, 0))"}[left[0]]()
    return f"CASE WHEN {value} < {limit}::DOUBLE THEN {_case(tree, 2 * i + 2)} ELSE {_case(tree, 2 * i + 1)} END"


BANDS = sorted({b for tree in rules.TREES.values() for b in rules.tree_bands(tree)})


@query("WITH p AS (SELECT vec_id, " + ", ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) + 0.5) / 2 AS {b}" for i, b in enumerate(BANDS)) + " FROM embeddings) SELECT vec_id, " + ", ".join(f"{_case(tree)} AS {name}" for name, tree in rules.TREES.items()) + " FROM p")
def decision_trees(t, spark):
    """All decision trees, with bands, differences and ratios."""
    d = t("embeddings").select("vec_id", *(((F.col("embedding")[i].cast("double") + 0.5) / 2).alias(b) for i, b in enumerate(BANDS)))
    return d.select("vec_id", *(rules.tree_class(tree).alias(name) for name, tree in rules.TREES.items()))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice / 50000.0, 0), 1), 9)::DOUBLE AS unit, round(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0.5 * l_quantity + 2 END, 6)::DOUBLE AS radiance,
  CAST(CASE WHEN 65536 - l_suppkey * 700 > 15 AND 65536 - l_partkey * 40 > 15 THEN 1 ELSE 0 END AS INTEGER) AS water, CAST(CASE WHEN l_linenumber > 2 THEN 0 ELSE l_linenumber END AS INTEGER) AS label,
  CASE WHEN l_linenumber = 2 THEN l_quantity END AS masked, CAST(trunc(l_quantity) AS SMALLINT) AS short FROM lineitem""")
def pixel_scalars(t, spark):
    """Clamped reflectance, radiance with gaps in the constants, radar water, capped labels, masked and cast bands."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    some = lambda v: F.when(n != 1, F.lit(v))
    bands = F.struct(q.alias("b"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(pixel.unit_reflectance(F.col("l_extendedprice"), 50000.0), 9).alias("unit"), F.round(pixel.radiance(q, some(0.5), some(2.0)), 6).alias("radiance"), pixel.sar_water(pixel.inverted(F.col("l_suppkey") * 700), pixel.inverted(F.col("l_partkey") * 40)).alias("water"), pixel.capped_label(n).alias("label"), F.when(n == 2, q).alias("masked"), bands["b"].cast("short").alias("short"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 1 THEN 1321.0789 / ln(774.8853 / (3.3e-4 * l_quantity + 0.1) + 1) ELSE (3.3e-4 * l_quantity + 0.1) / sin(radians(30 + l_linenumber)) END, 8) AS toa FROM lineitem""")
def to_toa(t, spark):
    """Reflectance or brightness temperature, by the kind of band."""
    n = F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(pixel.to_toa(F.col("l_quantity"), n == 1, F.lit(3.3e-4), F.lit(0.1), 30 + n, F.lit(774.8853), F.lit(1321.0789)), 8).alias("toa"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v > 0.1)) AS BIGINT) AS n FROM embeddings")
def class_counts(t, spark):
    return aggregate.class_count(long_frames(t).withColumn("c", (F.col("v") > F.lit(0.1).cast("float").cast("double")).cast("int")), ["vec_id"], "c", 1)


# frames

@query(FRAMES + """, w AS (SELECT *, exp(-0.5 * d * d / 0.49) / sum(exp(-0.5 * d * d / 0.49)) OVER () AS w FROM (SELECT unnest(generate_series(-3, 3)) AS d)),
m AS (SELECT i, CASE WHEN i < 0 THEN -i - 1 WHEN i > 7 THEN 15 - i ELSE i END AS at FROM (SELECT unnest(generate_series(-3, 10)) AS i)),
a AS (SELECT f.vec_id, g.y, f.x, sum(CAST(f.v AS DOUBLE) * w.w) AS v FROM (SELECT DISTINCT y FROM f) g CROSS JOIN w JOIN m ON m.i = g.y + w.d JOIN f ON f.y = m.at GROUP BY ALL),
b AS (SELECT a.vec_id, a.y, g.x, sum(a.v * w.w) AS v FROM (SELECT DISTINCT x FROM f) g CROSS JOIN w JOIN m ON m.i = g.x + w.d JOIN a ON a.x = m.at GROUP BY ALL) SELECT vec_id, y, x, round(v, 6) AS v FROM b""")
def gaussian(t, spark):
    """A Gaussian filter with mirrored edges."""
    d = frames.smoothed(long_frames(t), ["vec_id"], "v", 0.7)
    return d.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(FRAMES + " SELECT vec_id, y - 100 AS y, x + 50 AS x, round(CAST(v AS DOUBLE), 6) AS v FROM f WHERE y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 5")
def stitched_chips(t, spark):
    """Cut into chips, stitched again and cropped; coordinates may be negative."""
    f = long_frames(t).withColumns({"y": F.col("y") - 100, "x": F.col("x") + 50})
    d = chips.crop(chips.from_chips(chips.to_chips(f, 3).drop("y", "x"), 3), -98, 53, 3)
    return d.select("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("v", 6).alias("v"))


@query(FRAMES + ", g AS (SELECT DISTINCT vec_id FROM f) SELECT g.vec_id, 81 AS n, 17 AS missing, 5.0::DOUBLE AS finer, 15.0::DOUBLE AS coarser FROM g")
def padded_with_null(t, spark):
    """Padding without a fill, and edges at other resolutions, plain and with the older factors."""
    d = chips.pad(long_frames(t), ["vec_id"], 8, 8, 3, "v", None)
    return d.groupBy("vec_id").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("v").isNull()).cast("int").alias("missing")).withColumns({"finer": F.lit(float(chips.target_size(10, 10, 20))), "coarser": F.lit(float(chips.target_size(15, 20, 10, legacy=True)))})


@query(cubes.cleaned_sql(cubes.MASK, 3) + """, t AS (SELECT vec_id, c, count(*) * 100.0::DOUBLE AS area, min(y) AS min_y, max(x) AS max_x, round(avg(y), 6) AS centre_y FROM k WHERE (vec_id, c) IN (SELECT vec_id, c FROM k WHERE y = 0) GROUP BY ALL)
SELECT vec_id, area, min_y, max_x, centre_y FROM t""")
def component_table(t, spark):
    """Components that touch the top row of their frame, as a table instead of outlines."""
    c = frames.components(cubes.mask(t), ["vec_id"], "mask", 1, 3)
    top = spark.range(8).select(F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    d = frames.component_table(frames.on_burned(c, top, ["vec_id"]), ["vec_id"], 10.0)
    return d.select("vec_id", "area", "min_y", "max_x", F.round("centre_y", 6).alias("centre_y"))


@query(FRAMES + """, m AS (SELECT vec_id, y // 2 AS i, x // 2 AS j, avg(CAST(v AS DOUBLE)) AS a FROM f GROUP BY ALL) SELECT f.vec_id, f.y, f.x, CAST((m.a - 0.01) / 0.2 > 0 AS INTEGER) AS mask FROM f JOIN m ON m.vec_id = f.vec_id AND m.i = f.y // 2 AND m.j = f.x // 2""")
def chained_inference(t, spark):
    """Resize, pad, cut, normalise, score, stitch, unpad and resize back."""
    return frames.inferred(long_frames(t), ["vec_id"], "v", 8, 4, 3, lambda batch: [(v > 0).astype(int) for v in batch], 0.01, 0.2)


@query(FRAMES + """, p AS (SELECT vec_id % 2 AS constellation, vec_id // 2 % 4 AS tile_id, vec_id // 8 AS date, y, x, v FROM f), d AS (SELECT constellation, date FROM p GROUP BY ALL HAVING count(DISTINCT tile_id) = 4)
SELECT constellation, date, CAST((1 - tile_id // 2) * 8 + y AS BIGINT) AS gy, CAST(tile_id % 2 * 8 + x AS BIGINT) AS gx, round(CAST(v AS DOUBLE), 6) AS v FROM p JOIN d USING (constellation, date)""")
def multi_tile_cube(t, spark):
    """Two constellations of four tiles each on the dates that all tiles have."""
    v = F.col("vec_id")
    p = long_frames(t).select((v % 2).alias("constellation"), F.floor(v / 2).alias("_t"), F.floor(v / 8).alias("date"), "y", "x", "v").withColumn("tile_id", F.col("_t") % 4).drop("_t")
    tiles = spark.range(4).select(F.col("id").alias("tile_id"), (F.col("id") % 2).alias("xloc"), F.floor(F.col("id") / 2).alias("yloc"))
    return chips.cube(p, tiles, 8).select("constellation", "date", "gy", "gx", F.round("v", 6).alias("v"))


# models

@query(FRAMES + """, b AS (SELECT a.vec_id, a.y, a.x, count(*) AS n, avg(abs(CAST(b.v AS DOUBLE)) + 0.1) AS c11, avg(abs(CAST(b.v AS DOUBLE)) / 2) AS c22 FROM f a JOIN f b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)
SELECT vec_id, y, x, round(CASE WHEN n = 25 THEN c22 / c11 * (c22 / c11 + 3) / ((c22 / c11 + 1) * (c22 / c11 + 1)) * CASE WHEN c11 > c22 AND 10 * log10(c11) >= -17 THEN 1 ELSE 0 END END, 5) AS dprvic FROM b""")
def soil_moisture(t, spark):
    """The dual-polarised index from 5 x 5 means, as a model found by name."""
    d = long_frames(t).withColumns({"vv": F.abs("v") + 0.1, "vh": F.abs("v") / 2})
    return models.model("soil_moisture")(d, keys=["vec_id"]).select("vec_id", "y", "x", F.round("dprvic", 5).alias("dprvic"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_orderkey % 65536 AS w FROM lineitem) SELECT l_orderkey, l_linenumber, CAST((w >> 8 & 3) = 3 AS INTEGER) AS cloud FROM c""")
def cloud_model(t, spark):
    """The cloud model of a quality word."""
    d = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 65536).cast("int").alias("bqa"))
    return models.model("cloud_mask")(d, constellation="landsat-8").select("l_orderkey", "l_linenumber", "cloud")


# evaluation

@query("""WITH l AS (SELECT label % 4 AS p, CAST(vec_id % 4 AS INTEGER) AS t, vec_id % 9 AS area FROM embeddings WHERE vec_id % 9 <> 3 OR vec_id % 4 <> 1)
SELECT area, CASE WHEN bool_or(t = 1) THEN round(sum(CAST(p = 1 AND t = 1 AS INTEGER)) / nullif(sum(CAST(p = 1 AS INTEGER)), 0), 6) END AS precision, CASE WHEN bool_or(t = 1) THEN round(sum(CAST(p = 1 AND t = 1 AS INTEGER)) / sum(CAST(t = 1 AS INTEGER)), 6) END AS recall,
CASE WHEN bool_or(t = 1) THEN round(sum(CAST(p = 1 AND t = 1 AS INTEGER)) / sum(CAST(p = 1 OR t = 1 AS INTEGER)), 6) END AS iou FROM l GROUP BY area""")
def single_class_metrics(t, spark):
    """Scores of one class by area; null where the truth lacks it."""
    d = t("embeddings").where("vec_id % 9 <> 3 or vec_id % 4 <> 1").select((F.col("label") % 4).alias("p"), (F.col("vec_id") % 4).cast("int").alias("t"), (F.col("vec_id") % 9).alias("area"))
    return metrics.single_class(d, "p", "t", 1, ["area"]).select("area", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "iou")))


HARNESS = """SELECT vec_id % 7 AS area, round(avg(CAST((CAST(embedding[1] AS DOUBLE) > 0) = (CAST(embedding[2] AS DOUBLE) > 0) AS INTEGER)), 6) AS accuracy, round(avg(abs(CAST(CAST(embedding[1] AS DOUBLE) > 0 AS INTEGER) - CAST(CAST(embedding[2] AS DOUBLE) > 0 AS INTEGER))) * 100, 4) AS wrong, '{}' AS source FROM embeddings GROUP BY 1"""


@query(HARNESS.format("stored") + " UNION ALL " + HARNESS.format("fresh"))
def evaluation_harness(t, spark):
    """Every area's scores against stored masks and against fresh predictions, with a metric of one's own."""
    e = F.col("embedding")
    truth = t("embeddings").select("vec_id", (F.col("vec_id") % 7).alias("area"), (e[1] > 0).cast("int").alias("mask"), e[0].alias("band"))
    own = {"accuracy": metrics.accuracy, "wrong": lambda a, b: F.avg(F.abs(a - b)) * 100}
    stored = truth.select("vec_id", "area", (F.col("band") > 0).cast("int").alias("mask"))
    metrics.same_pixels(stored, truth, ["vec_id", "area"])
    fresh = lambda d: d.withColumn("mask", (F.col("band") > 0).cast("int"))
    run = lambda masks, predict, name: metrics.harness(truth, masks, ["vec_id", "area"], "mask", own, ["area"], predict).withColumn("source", F.lit(name))
    both = run(stored, None, "stored").unionByName(run(None, fresh, "fresh"))
    return both.select("area", F.round("accuracy", 6).alias("accuracy"), F.round("wrong", 4).alias("wrong"), "source")


@query("SELECT l_returnflag AS k, round(avg(s), 4) AS stat FROM (SELECT l_returnflag, l_linenumber, max(l_quantity) - min(l_quantity) AS s FROM lineitem GROUP BY ALL) GROUP BY 1")
def custom_reducer(t, spark):
    """A reducer of one's own, as a function of a column name, in the two-level statistic."""
    aggregate.STATS["range"] = lambda c: F.max(c) - F.min(c)
    return aggregate.stat_per_band(t("lineitem").withColumnRenamed("l_returnflag", "k"), ["k"], ["l_linenumber"], "l_quantity", "range").select("k", F.round("stat", 4).alias("stat"))


@query("SELECT count(*) AS n, CAST(40 AS INTEGER) AS size FROM part")
def tile_sizes(t, spark):
    """The one size of square tiles."""
    d = t("part").select(F.lit(40).alias("w"), F.lit(40).alias("h"))
    return d.agg(F.count("*").alias("n")).withColumn("size", F.lit(aggregate.same_size(d, "w", "h")))


# samples

@query("SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS strided, CAST(vec_id // 150 AS INTEGER) AS run FROM embeddings")
def worker_shares(t, spark):
    return t("embeddings").select("vec_id", chips.worker_share(F.col("vec_id"), 600, 4).alias("strided"), chips.worker_share(F.col("vec_id"), 600, 4, strided=False).alias("run"))


@query(FRAMES + """, p AS (SELECT vec_id, y, x, (CAST(v AS DOUBLE) - 0.1) / 0.5 AS z, CASE WHEN v > 0.3 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS label FROM f)
SELECT vec_id, y, x, round(z, 6) AS z, CAST(label AS INTEGER) AS label FROM p WHERE vec_id IN (SELECT vec_id FROM p GROUP BY 1 HAVING avg(CAST(label <> 0 AS INTEGER)) >= 0.5)""")
def training_chips(t, spark):
    """The chain of a training set: label from masks, filter, normalise; each a DataFrame transform."""
    labelled = lambda d: d.withColumn("label", pixel.masks_to_label([(F.col("v") > 0).cast("int"), (F.col("v") > F.lit(0.3).cast("double")).cast("int")]))
    kept = lambda d: aggregate.keep_filled(d, ["vec_id"], ["label"], 0.5)
    normal = lambda d: d.withColumn("z", (F.col("v") - 0.1) / 0.5)
    return long_frames(t).transform(labelled).transform(kept).transform(normal).select("vec_id", "y", "x", F.round("z", 6).alias("z"), "label")


# streams

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def events_stream(t, spark):
    """The events as files that arrive, one in each micro-batch."""
    path = scratch(spark)
    t("events").repartition(3).write.parquet(path)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def streamed_metrics(t, spark):
    """Metric rows appended as they arrive."""
    path = scratch(spark)
    incremental.append_each(events_stream(t, spark).select(F.col("event_type").alias("kind"), "value"), path, scratch(spark)).awaitTermination()
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT user_id % 4 AS tile_id, CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(CAST(value > 50 AS INTEGER)) AS BIGINT) AS water FROM events GROUP BY ALL")
def streamed_masks(t, spark):
    """Masks filled in as revisits arrive; a batch that comes again changes nothing."""
    root = scratch(spark)
    classify = lambda d: d.select((F.col("user_id") % 4).alias("tile_id"), F.to_date("ts").alias("date"), "event_id", (F.col("value") > 50).cast("int").alias("mask"))
    write = lambda d: d.write.mode("append").parquet(root)
    incremental.fill_masks(events_stream(t, spark), classify, write, scratch(spark)).awaitTermination()
    return spark.read.parquet(root).dropDuplicates(["event_id"]).groupBy("tile_id", "date").agg(F.count("*").alias("n"), F.sum("mask").alias("water"))


@query("SELECT event_id FROM events WHERE (user_id, CAST(ts AS DATE)) IN (SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_id % 50 = 0)")
def chosen_revisits(t, spark):
    """Exactly the revisits that were asked for."""
    e = t("events").withColumn("date", F.to_date("ts"))
    return incremental.chosen(e, e.where("event_id % 50 = 0").select("user_id", "date").distinct(), ["user_id", "date"]).select("event_id")


@query("SELECT c_custkey AS k, c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY place LIMIT 50")
def ordered_records(t, spark):
    """Rows in order of a value, with their places: a top list."""
    from pyspark.sql import Window

    top = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")).orderBy(F.desc("v"), "k").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("v"), "k")).cast("long"))
