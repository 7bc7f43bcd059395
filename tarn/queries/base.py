from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (table reader, session) under its name, with its SQL."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return wrap


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; without a cluster, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarn-")
    return f"{root.rstrip('/')}/query-{uuid.uuid4().hex}"


def water_ts(t) -> DataFrame:
    """``events`` as the area fact; run ids of several lengths, some without a version."""
    e = t("events")
    return e.select(
        F.col("user_id").alias("area_id"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("constellation"),
        F.col("value").alias("area"),
        F.when(F.col("event_id") % 7 == 0, F.lit("run")).otherwise(F.concat(F.lit("run_"), F.col("event_id").cast("string"))).alias("run_id"),
    )


WATER = """WITH water_ts AS (SELECT user_id AS area_id, CAST(ts AS DATE) AS date, event_type AS constellation, value AS area,
  CASE WHEN event_id % 7 = 0 THEN 'run' ELSE 'run_' || event_id END AS run_id, event_id FROM events)"""


def frames(t) -> DataFrame:
    """``embeddings`` as 8 x 8 frames in long form."""
    from tarn.operators.frames import frames_of_vectors

    return frames_of_vectors(t("embeddings"), "vec_id", "embedding", 8)


FRAMES = """WITH f AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(v AS FLOAT) AS v FROM
  (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def r4(c: str, name: str | None = None):
    return F.round(F.col(c).cast("double"), 4).alias(name or c)
