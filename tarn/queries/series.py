"""Series queries: latest runs, resampling, windows, features."""

from pyspark.sql import functions as F

from tarn.operators import timeseries as ts
from tarn.plans import water
from tarn.queries.base import WATER, query, water_ts
from tarn.sources import sinks

LATEST = WATER + """, latest AS (SELECT area_id, date, constellation, area FROM (SELECT *, row_number() OVER (PARTITION BY area_id, date, constellation
  ORDER BY string_split(run_id, '_')[2] DESC NULLS LAST, area DESC) AS n FROM water_ts WHERE area > 0) WHERE n = 1)"""


@query(LATEST + " SELECT area_id, date, constellation, area FROM latest")
def latest_run_area(t, spark):
    """Area of the latest run of each (area, date, constellation)."""
    return water.area_points(water_ts(t)).select("area_id", "date", "constellation", "area")


@query(LATEST + """, span AS (SELECT area_id, constellation, min(date) AS d0, max(date) AS d1 FROM latest GROUP BY ALL),
grid AS (SELECT area_id, constellation, d0, unnest(generate_series(0, (d1 - d0) // 10)) AS bin FROM span),
bins AS (SELECT area_id, constellation, (date - d0) // 10 AS bin, avg(area) AS m FROM latest JOIN span USING (area_id, constellation) GROUP BY ALL)
SELECT g.area_id, g.constellation, CAST(d0 + CAST(g.bin * 10 AS INTEGER) AS DATE) AS date, CAST(trunc(coalesce(m, 0)) AS BIGINT) AS area
FROM grid g LEFT JOIN bins b ON g.area_id = b.area_id AND g.constellation = b.constellation AND g.bin = b.bin""")
def area_timeseries(t, spark):
    """The served series: latest runs in bins anchored at each series' first date (10 days here, so that gaps occur)."""
    return water.resampled(water.area_points(water_ts(t)), 10)


@query(LATEST + """ SELECT area_id, constellation, CAST(count(*) AS INTEGER) AS n, min(date) AS first_date, max(date) AS last_date FROM latest GROUP BY ALL""")
def nested_series(t, spark):
    """Nested response for every area, flattened again to sizes and ends."""
    n = sinks.series_by_key(water.area_points(water_ts(t)), ["area_id"])
    e = n.select("area_id", F.explode("series").alias("constellation", "s"))
    return e.select("area_id", "constellation", F.size("s").alias("n"), F.col("s")[0]["date"].alias("first_date"), F.element_at("s", -1)["date"].alias("last_date"))


@query("""WITH d AS (SELECT o_orderstatus AS k, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v FROM orders),
span AS (SELECT k, min(date) AS d0, max(date) AS d1 FROM d GROUP BY k),
grid AS (SELECT k, d0, unnest(generate_series(0, (d1 - d0) // 30)) AS bin FROM span),
bins AS (SELECT k, (date - d0) // 30 AS bin, avg(v) AS m FROM d JOIN span USING (k) GROUP BY ALL)
SELECT g.k AS status, CAST(d0 + CAST(g.bin * 30 AS INTEGER) AS DATE) AS date, CAST(trunc(coalesce(m, 0)) AS BIGINT) AS price FROM grid g LEFT JOIN bins b ON g.k = b.k AND g.bin = b.bin""")
def resample_30d(t, spark):
    """30-day means anchored at each series' own first date."""
    d = t("orders").select(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"))
    return ts.resample(d, "status", "date", "price", 30)


@query(WATER + " SELECT area_id, date, area FROM (SELECT *, row_number() OVER (PARTITION BY area_id, date ORDER BY area DESC, run_id) AS n FROM water_ts) WHERE n = 1")
def keep_one_per_date(t, spark):
    """The greatest area of each date (ties by run)."""
    return ts.pick(water_ts(t), ["area_id", "date"], [F.col("area").desc(), F.col("run_id")]).select("area_id", "date", "area")


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS n FROM events) WHERE n = 1")
def first_of_duplicates(t, spark):
    return ts.pick(t("events"), ["user_id", "ts"], [F.col("event_id")]).select("user_id", "ts", "event_id")


@query("""SELECT event_id, round(CASE WHEN count(*) OVER w = 50 THEN avg(value) OVER w END, 4) AS smooth FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def rolling_50_mean(t, spark):
    return ts.rolling_rows(t("events"), ["user_id"], ["ts", "event_id"], "value", 50, "smooth").select("event_id", F.round("smooth", 4).alias("smooth"))


@query("""WITH d AS (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT status, date, round(avg(price) OVER (PARTITION BY status ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 0) AS smooth FROM d""")
def rolling_30d_mean(t, spark):
    d = t("orders").groupBy(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("price"))
    return ts.rolling_days(d, ["status"], "date", "price", 30, "smooth").select("status", "date", F.round("smooth", 0).alias("smooth"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS sum_3 FROM events""")
def rolling_sum_3(t, spark):
    return ts.rolling_rows(t("events"), ["user_id"], ["ts", "event_id"], "value", 3, "sum_3", "sum", full=False).select("event_id", F.round("sum_3", 4).alias("sum_3"))


MONTHS = "WITH m AS (SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(round(sum(o_totalprice)) AS BIGINT) AS v FROM orders GROUP BY ALL)"


def months(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status"), F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("v"))


@query(MONTHS + """ SELECT status, month, v, lag(v, 1) OVER w AS lag_1, lag(v, 2) OVER w AS lag_2, lag(v, 12) OVER w AS lag_12, lead(v, 1) OVER w AS lead_1, lead(v, 7) OVER w AS lead_7
FROM m WINDOW w AS (PARTITION BY status ORDER BY month)""")
def lag_lead_features(t, spark):
    return ts.lags(months(t), ["status"], ["month"], "v", [1, 2, 12, -1, -7])


@query(MONTHS + """ SELECT status, month, round(lag(v) OVER w / nullif(v, 0), 6) AS left_ratio, round(lead(v) OVER w / nullif(v, 0), 6) AS right_ratio,
lag(v) OVER w + v + lead(v) OVER w AS sum_3, v - lag(v) OVER w AS diff_left, lead(v) OVER w - v AS diff_right FROM m WINDOW w AS (PARTITION BY status ORDER BY month)""")
def neighbour_ratio_features(t, spark):
    d = ts.neighbour_ratios(months(t), ["status"], ["month"], "v")
    return d.select("status", "month", F.round("left_ratio", 6).alias("left_ratio"), F.round("right_ratio", 6).alias("right_ratio"), F.col("sum_3").cast("decimal(38,0)").cast("long").alias("sum_3"), "diff_left", "diff_right")


@query(MONTHS + " SELECT status, month, v - coalesce(lag(v) OVER (PARTITION BY status ORDER BY month), 0) AS step FROM m")
def decumulated(t, spark):
    return ts.differences(months(t), ["status"], ["month"], "v", "step").select("status", "month", "step")


DAYS = """WITH d AS (SELECT user_id AS area_id, CAST(ts AS DATE) AS date, max(value) AS v FROM events GROUP BY ALL),
g AS (SELECT area_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY area_id),
j AS (SELECT g.area_id, g.date, v FROM g LEFT JOIN d USING (area_id, date))"""


def by_day(t):
    d = t("events").groupBy(F.col("user_id").alias("area_id"), F.to_date("ts").alias("date")).agg(F.max("value").alias("v"))
    return ts.daily(d, ["area_id"], "date")


@query(DAYS + " SELECT area_id, date, last_value(v IGNORE NULLS) OVER (PARTITION BY area_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled FROM j")
def daily_forward_fill(t, spark):
    return ts.forward_fill(by_day(t), ["area_id"], ["date"], "v", "filled").select("area_id", "date", "filled")


@query(DAYS + """, k AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY date) AS i FROM j),
p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, last_value(v IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1, first_value(v IGNORE NULLS) OVER a AS v1 FROM k
  WINDOW b AS (PARTITION BY area_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY area_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT area_id, date, round(coalesce(v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0), v0), 4) AS line FROM p""")
def linear_interpolation(t, spark):
    return ts.interpolate(by_day(t), ["area_id"], ["date"], "v", "line").select("area_id", "date", F.round("line", 4).alias("line"))


@query(MONTHS + """, n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY month) AS i, count(*) OVER (PARTITION BY status) AS n FROM m),
f AS (SELECT *, unnest([0, 1, 2]) AS fold, n // 4 AS s FROM n)
SELECT status, fold, role, count(*) AS n, min(month) AS first_month FROM
(SELECT *, CASE WHEN i <= n - (3 - fold) * s THEN 'train' WHEN i <= n - (3 - fold) * s + s THEN 'test' END AS role FROM f) WHERE role IS NOT NULL GROUP BY ALL""")
def expanding_folds(t, spark):
    return ts.folds(months(t), ["status"], ["month"], 3).groupBy("status", "fold", "role").agg(F.count("*").alias("n"), F.min("month").alias("first_month"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY ALL)
SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(avg(v), 4) AS mean FROM d GROUP BY ALL""")
def monthly_mean_of_means(t, spark):
    return ts.monthly_mean(t("events").select(F.to_date("ts").alias("date"), "value"), "date", "value", "mean").select("month", F.round("mean", 4).alias("mean"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) AS f1_sum_2, round(l_quantity + l_tax + l_discount, 4) AS f1_sum_3,
round(l_extendedprice + l_quantity, 4) AS f2_sum_2, round(l_extendedprice + l_quantity + l_tax, 4) AS f2_sum_3 FROM lineitem""")
def forecast_sums(t, spark):
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("f1"), F.col("l_extendedprice").alias("f2"), "l_tax", "l_discount")
    d = ts.forecast_sums(d, ["f1", "f2"], ["l_tax", "l_discount"])
    return d.select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in ("f1_sum_2", "f1_sum_3", "f2_sum_2", "f2_sum_3")))


@query("SELECT event_id, ts, user_id FROM events WHERE user_id % 2 = 0 ORDER BY ts, event_id LIMIT 100")
def first_100(t, spark):
    """Filter and top-k: one task keeps 100 rows of each other task."""
    return t("events").where("user_id % 2 = 0").select("event_id", "ts", "user_id").orderBy("ts", "event_id").limit(100)


@query("""SELECT event_type AS constellation, CAST(time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1970-01-01') AS DATE) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_30_days(t, spark):
    """Windows that start at multiples of 30 days since 1970."""
    from tarn.streaming.incremental import windowed

    d = windowed(t("events").withColumn("time", F.col("ts").cast("timestamp")), "time", "event_type", "value", "30 days")
    return d.select(F.col("event_type").alias("constellation"), F.to_date("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, k""")
def session_windows(t, spark):
    from tarn.streaming.incremental import sessions

    d = sessions(t("events").withColumn("time", F.col("ts").cast("timestamp")), "time", "user_id", "6 hours")
    return d.select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))


@query(WATER + """ SELECT area_id, date, constellation, area FROM (SELECT *, row_number() OVER (PARTITION BY area_id, date, constellation
  ORDER BY string_split(run_id, '_')[2] DESC NULLS LAST, area DESC) AS n FROM water_ts) WHERE n = 1""")
def latest_by_aggregate(t, spark):
    """The streaming form of the latest run, run as a batch."""
    from tarn.streaming.incremental import latest_stream

    return latest_stream(water_ts(t), ["area_id", "date", "constellation"])


@query("""SELECT user_id AS aoi_id, CAST(ts AS DATE) AS date, min(CAST(json_extract(props, '$.k') AS DOUBLE)) AS value FROM events
WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts""")
def json_keyed_values(t, spark):
    """Label filter, JSON key and one value for each area and time."""
    from tarn.sources.tables import keyed_values

    e = t("events")
    label = e.agg(F.min("event_type")).scalar()
    d = e.select(F.col("user_id").alias("aoi_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"), F.array("event_type").alias("labels"), F.from_json("props", "map<string,string>").alias("keyed_values"))
    return keyed_values(d, label, "k")


@query("""WITH d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts FROM events)
SELECT user_id, a.ts AS date, b.ts AS input_date FROM d a JOIN d b USING (user_id) WHERE b.n BETWEEN a.n - 2 AND a.n""")
def label_range(t, spark):
    from tarn.operators.chips import label_range as op

    e = t("events").select("user_id", F.struct("ts", "event_id").alias("d"))
    return op(e, ["user_id"], "d", 2).select("user_id", F.col("d.ts").alias("date"), F.col("input_date.ts").alias("input_date"))


@query("""WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time, CAST(day(o_orderdate) AS BIGINT) - 1 AS step, avg(o_totalprice) AS tp FROM orders GROUP BY ALL)
SELECT CAST(time + CAST(step AS INTEGER) AS DATE) AS date, round(tp - coalesce(lag(tp) OVER (PARTITION BY time ORDER BY step), 0), 0) AS tp FROM c""")
def seasonal_daily(t, spark):
    """Daily steps of cumulative monthly forecasts, averaged over members and cells."""
    from tarn.plans.seasonal import daily

    o, d = t("orders"), F.to_date("o_orderdate")
    cube = o.select(F.trunc(d, "month").alias("time"), (F.day(d) - 1).cast("long").alias("step"), (F.col("o_custkey") % 3).alias("member"), (F.col("o_orderkey") % 2).alias("latitude"), F.lit(0).alias("longitude"), F.col("o_totalprice").alias("tp"))
    return daily(cube).select("date", F.round("tp", 0).alias("tp"))


@query("""WITH d AS (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price FROM orders GROUP BY ALL),
r AS (SELECT status, date, avg(price) OVER (PARTITION BY status ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS m FROM d)
SELECT status, date, round(m, 0) AS mean FROM r WHERE day(date) = 1""")
def month_start_means(t, spark):
    from tarn.plans.seasonal import month_starts

    d = t("orders").groupBy(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("price"))
    return month_starts(d, ["status"], "date", "price").select("status", "date", F.round("mean", 0).alias("mean"))


@query("""WITH f AS (SELECT user_id % 6 AS aoi, event_id % 3 AS fold, value, value * 0.9 + 1 AS pred FROM events), m AS (SELECT aoi, fold, avg((value - pred) * (value - pred)) AS mse FROM f GROUP BY ALL)
SELECT aoi, round(avg(mse), 4) AS mse FROM m GROUP BY aoi""")
def fold_errors(t, spark):
    """Mean over folds of each area's squared error."""
    from tarn.operators.metrics import evaluate

    f = t("events").select((F.col("user_id") % 6).alias("aoi"), (F.col("event_id") % 3).alias("fold"), "value", (F.col("value") * 0.9 + 1).alias("pred"))
    m = evaluate(f, "pred", "value", ["mse"], ["aoi", "fold"])
    return m.groupBy("aoi").agg(F.round(F.avg("mse"), 4).alias("mse"))
