"""Writers: mask partitions, revisit records, index maps, nested series."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_PARTITIONS = ("model", "constellation", "tile_id", "date")


def write_masks(df: DataFrame, root: str) -> None:
    """Replace exactly the (model, constellation, tile, date) partitions that ``df`` holds; running it again changes nothing."""
    d = df.repartition("constellation", "tile_id", "date").sortWithinPartitions("date", "y", "x")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MASK_PARTITIONS).parquet(root)


def revisit_records(df: DataFrame) -> DataFrame:
    """Multi-measure records: dimensions, measures as text, time as milliseconds."""
    dims = F.to_json(F.struct("aoi_id", "constellation"))
    return df.select(dims.alias("dimensions"), F.create_map(F.lit("res_level"), F.col("res_level").cast("string"), F.lit("cloud_coverage"), F.col("cloud_coverage").cast("string")).alias("measures"), F.unix_millis(F.col("time").cast("timestamp")).cast("string").alias("time"))


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_index_map(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=False)


def nested_series(ts: DataFrame, key: str, date: str = "date", value: str = "area") -> Column:
    """Aggregate: {key: [{date, value} by date]} over pre-grouped rows; see ``series_by_key``."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "series"))))


def series_by_key(ts: DataFrame, outer: list[str], key: str = "constellation", date: str = "date", value: str = "area") -> DataFrame:
    """(outer, series): a map from key to its values in order of date."""
    each = ts.groupBy(*outer, key).agg(F.sort_array(F.collect_list(F.struct(date, value))).alias("series"))
    return each.groupBy(*outer).agg(nested_series(each, key, date, value).alias("series"))


def write_together(frames: dict[str, DataFrame], root: str) -> str:
    """Append several tables as one batch: all are staged under the batch's name and a marker row makes the batch visible last. Readers use ``read_batches``."""
    batch = uuid.uuid4().hex
    for name, df in frames.items():
        df.write.parquet(f"{root}/{name}/batch={batch}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{root}/_done")
    return batch


def read_batches(spark, root: str, name: str) -> DataFrame:
    done = spark.read.parquet(f"{root}/_done")
    return spark.read.parquet(f"{root}/{name}").join(done, "batch", "left_semi")
