"""Frame kernels over pixel tables: one group for each frame, one Arrow batch in and out.

A frame (one date of one mosaic) is the unit of parallel work and has a bounded
size; the kernels drop to numpy because morphology and component labelling have no
Column form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import kernels


def _grid(t: pa.Table, value: str, kind=np.int16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frame as an array that begins at its least row and column, and these; coordinates may lie anywhere."""
    yy, xx = t["y"].to_numpy().astype(np.int64), t["x"].to_numpy().astype(np.int64)
    top, left = yy.min(), xx.min()
    a = np.zeros((yy.max() - top + 1, xx.max() - left + 1), kind)
    a[yy - top, xx - left] = t[value].fill_null(0).to_numpy().astype(kind)
    return a, top, left


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def components(df: DataFrame, keys: list[str], value: str = "mask", cls: int = 1, limit: int = 50) -> DataFrame:
    """(keys, y, x, component) of the cleaned class pixels of each frame; background is left out."""

    def run(t: pa.Table) -> pa.Table:
        a, top, left = _grid(t, value)
        lab = kernels.clean(a, cls, limit)
        y, x = np.nonzero(lab)
        return pa.table([*(pa.array([t[k][0].as_py()] * len(y), t[k].type) for k in keys), pa.array((y + top).astype(np.int32)), pa.array((x + left).astype(np.int32)), pa.array(lab[y, x])], names=[*keys, "y", "x", "component"])

    return df.select(*keys, "y", "x", value).groupBy(*keys).applyInArrow(run, f"{_ddl(df, keys)}, y int, x int, component long")


def cleaned_area(df: DataFrame, keys: list[str], value: str = "mask", burn: str | None = None, cls: int = 1, limit: int = 50, resolution: float = 1.0) -> DataFrame:
    """(keys, area): pixels of the cleaned components, those touching the ``burn`` raster where given, times the squared resolution.

    One row leaves each frame; the pixels are shuffled once, by frame.
    """

    def run(t: pa.Table) -> pa.Table:
        lab = kernels.clean(_grid(t, value)[0], cls, limit)
        kept = kernels.touching(lab, _grid(t, burn)[0]) if burn else lab > 0
        return pa.table([*(pa.array([t[k][0].as_py()], t[k].type) for k in keys), pa.array([float(kept.sum()) * resolution**2])], names=[*keys, "area"])

    return df.select(*keys, "y", "x", value, *([burn] if burn else [])).groupBy(*keys).applyInArrow(run, f"{_ddl(df, keys)}, area double")


def smoothed(df: DataFrame, keys: list[str], value: str, sigma: float) -> DataFrame:
    """(keys, y, x, value) after a Gaussian filter of each frame."""

    def run(t: pa.Table) -> pa.Table:
        a, top, left = _grid(t, value, float)
        return pa.table([*(t[k] for k in keys), t["y"], t["x"], pa.array(kernels.gaussian(a, sigma)[t["y"].to_numpy() - top, t["x"].to_numpy() - left])], names=[*keys, "y", "x", value])

    return df.select(*keys, "y", "x", value).groupBy(*keys).applyInArrow(run, f"{_ddl(df, [*keys, 'y', 'x'])}, `{value}` double")


def burned(rings: DataFrame, key: str, height: int, width: int, left: float, top: float, pixel: float, all_touched: bool = True) -> DataFrame:
    """(key, y, x) of the pixels that each ring (array of struct x, y) covers."""

    def run(batches):
        for b in batches:
            for i, ring in enumerate(b.column(1).to_pylist()):
                m = kernels.rasterise(np.array([(p["x"], p["y"]) for p in ring], float), height, width, left, top, pixel, all_touched)
                y, x = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(y), i))), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32))], names=[key, "y", "x"])

    return rings.select(key, "ring").mapInArrow(run, f"{_ddl(rings, [key])}, y int, x int")


def component_table(df: DataFrame, frame: list[str], resolution: float = 1.0) -> DataFrame:
    """One row for each component of ``components``: area, bounds and centre, in place of outlines."""
    return df.groupBy(*frame, "component").agg((F.count(F.lit(1)) * F.lit(resolution**2)).alias("area"), F.min("y").alias("min_y"), F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.max("x").alias("max_x"), F.avg("y").alias("centre_y"), F.avg("x").alias("centre_x"))


def scored(chips: DataFrame, scorer, keys: list[str], data: str = "data", out: str = "classes") -> DataFrame:
    """Class map of each chip from a pluggable scorer: flat values in, class codes out.

    ``scorer`` is a callable over a list of arrays. It is sent once and called on
    whole Arrow batches.
    """
    sent = chips.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scorer))

    def run(batches):
        score = cloudpickle.loads(sent.value)
        for b in batches:
            got = score([np.asarray(v) for v in b.column(len(keys)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array([np.asarray(g).astype(int).tolist() for g in got], pa.list_(pa.int32()))], names=[*keys, out])

    return chips.select(*keys, data).mapInArrow(run, f"{_ddl(chips, keys)}, `{out}` array<int>")


def inferred(df: DataFrame, keys: list[str], value: str, size: int, target: int, chip: int, scorer, mean: float, std: float, out: str = "mask") -> DataFrame:
    """(keys, y, x, out) of square frames from a scorer of chips: resized to ``target``, padded to whole chips, normalised, scored, stitched, unpadded and resized back by nearest neighbour."""
    from tarn.operators import chips

    small = chips.bilinear(df, keys, size, target, value)
    at = [*keys, "chip_i", "chip_j"]
    norm = lambda v: (v - F.lit(mean)) / F.lit(std)
    cut = chips.to_chips(small, chip).select(*at, F.struct((F.col("r") * chip + F.col("c")).alias("k"), norm(F.coalesce(F.col(value), F.lit(0.0))).alias("v")).alias("_p"))
    # padding: a row for each chip, so that none is missing; the pixels that a chip lacks are put in where it is made
    edge = F.sequence(F.lit(0), F.lit(-(-target // chip) - 1))
    every = small.select(*keys).distinct().withColumn("chip_i", F.explode(edge)).withColumn("chip_j", F.explode(edge)).withColumn("_p", F.lit(None).cast(cut.schema["_p"].dataType))
    has = F.collect_list("_p")
    lacks = F.array_except(F.sequence(F.lit(0), F.lit(chip * chip - 1)), F.transform(has, lambda p: p["k"]))
    full = F.array_sort(F.concat(has, F.transform(lacks, lambda k: F.struct(k.alias("k"), norm(F.lit(0.0)).alias("v")))))
    batch = cut.unionByName(every).groupBy(*at).agg(F.transform(full, lambda p: p["v"]).alias("data"))
    got = scored(batch, scorer, at).select(*at, F.posexplode("classes").alias("_k", out))
    flat = chips.from_chips(got.withColumns({"r": F.floor(F.col("_k") / chip).cast("int"), "c": F.pmod("_k", F.lit(chip)).cast("int")}), chip)
    kept = flat.where((F.col("y") < target) & (F.col("x") < target)).select(*keys, "y", "x", out)
    return chips.nearest(kept, keys, target, size, out)


def on_burned(components_df: DataFrame, raster: DataFrame, frame: list[str]) -> DataFrame:
    """Pixels of the components that touch the raster (y, x), as joins: the raster picks components, a semi join keeps their pixels."""
    hit = components_df.join(raster.select("y", "x"), ["y", "x"], "left_semi").select(*frame, "component").distinct()
    return components_df.join(hit, [*frame, "component"], "left_semi")


def frames_of_vectors(df: DataFrame, key: str, vector: str, edge: int) -> DataFrame:
    """(key, y, x, v): a flat vector as a square frame."""
    return df.select(key, F.posexplode(vector).alias("i", "v")).select(key, F.floor(F.col("i") / edge).cast("int").alias("y"), F.pmod(F.col("i"), F.lit(edge)).cast("int").alias("x"), "v")
