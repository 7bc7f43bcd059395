"""Property graph as two tables: vertices (id, label, props) and edges (src, dst, label, props)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out(vertices: DataFrame, edges: DataFrame, start: DataFrame, label: str) -> DataFrame:
    """Vertices one ``label`` edge away from ``start`` (id)."""
    hop = edges.where(F.col("label") == label).join(start.select(F.col("id").alias("src")), "src", "left_semi")
    return hop.select("src", F.col("dst").alias("id")).join(vertices, "id")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other) in both directions, each pair once."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()


def neighbour_mean(vertices: DataFrame, edges: DataFrame, value: str, out: str = "mean") -> DataFrame:
    """Mean of a number, or of the entries of a list, over each vertex's neighbours."""
    v = vertices.select(F.col("id").alias("other"), F.col(value).alias("_v"))
    if vertices.schema[value].dataType.typeName() == "array":
        v = v.select("other", F.explode("_v").alias("_v"))
    return neighbours(edges).join(v, "other").groupBy("id").agg(F.avg("_v").alias(out))


def merge_attributes(vertices: DataFrame, new: DataFrame, listed: list[str], order: str) -> DataFrame:
    """Attributes (id, name, value, ``order``) for known vertices: the ``listed`` ones gather into lists in order, others keep the first. An unknown id is a KeyError."""
    if not new.join(vertices, "id", "left_anti").isEmpty():
        raise KeyError("attributes of an unknown vertex")
    rows = F.sort_array(F.collect_list(F.struct(order, "value")))
    g = new.groupBy("id", "name").agg(F.transform(rows, lambda r: r["value"]).alias("all"))
    return g.withColumn("values", F.when(F.col("name").isin(listed), F.col("all")).otherwise(F.slice("all", 1, 1))).drop("all")


def revisit_rows(revisits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of new revisits (id, satellite, aoi; ids as text): both or neither are to be written (see ``sources.sinks.write_together``)."""
    revisits = revisits.select(*(F.col(c).cast("string").alias(c) for c in ("id", "satellite", "aoi")))
    v = revisits.select("id", F.lit("revisit").alias("label"), F.create_map(F.lit("satellite"), F.col("satellite"), F.lit("aoi"), F.col("aoi")).alias("props"))
    e = revisits.select(F.col("satellite").alias("src"), F.col("id").alias("dst"), F.lit("captures").alias("label")).unionByName(revisits.select(F.col("id").alias("src"), F.col("aoi").alias("dst"), F.lit("on").alias("label")))
    return v, e


def coordinate_attributes(df: DataFrame, keys: list[str]) -> DataFrame:
    """bbox [first x, last y, last x, first y] and distinct times of a cube's coordinates."""
    return df.groupBy(*keys).agg(F.array(F.min("x"), F.min("y"), F.max("x"), F.max("y")).alias("bbox"), F.sort_array(F.collect_set("time")).alias("times"))
