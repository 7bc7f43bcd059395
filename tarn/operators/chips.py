"""Chips, mosaics, padding, resizing and sampling grids as key arithmetic.

A pixel table carries its position; cutting into chips, stitching back and padding
are then projections, and grids of chips are sequences exploded from sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_chips(df: DataFrame, size: int, y: str = "y", x: str = "x") -> DataFrame:
    """Add chip_i, chip_j and the position inside the chip."""
    return df.withColumns({"chip_i": F.floor(F.col(y) / size).cast("int"), "chip_j": F.floor(F.col(x) / size).cast("int"), "r": F.pmod(F.col(y), F.lit(size)).cast("int"), "c": F.pmod(F.col(x), F.lit(size)).cast("int")})


def from_chips(df: DataFrame, size: int) -> DataFrame:
    """Inverse of ``to_chips``."""
    return df.withColumns({"y": F.col("chip_i") * size + F.col("r"), "x": F.col("chip_j") * size + F.col("c")}).drop("chip_i", "chip_j", "r", "c")


def padded(n: Column, to: int) -> Column:
    """The next multiple of ``to``."""
    return (F.ceil(n / to) * to).cast("int")


def pad(df: DataFrame, keys: list[str], height: int, width: int, to: int, value: str, fill: float | None = 0) -> DataFrame:
    """Every pixel of each frame's padded grid; absent ones get ``fill``. The grid is merged, never broadcast: it has many rows for each frame, which Spark's estimate of it lacks."""
    h, w = -(-height // to) * to, -(-width // to) * to
    grid = df.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    j = grid.hint("merge").join(df, [*keys, "y", "x"], "left")
    return j.withColumn(value, F.coalesce(F.col(value), F.lit(fill))) if fill is not None else j


def mosaic(pixels: DataFrame, tiles: DataFrame, patch: int) -> DataFrame:
    """Global (gy, gx) of the pixels of all tiles of one mosaic: y location falls downward, x rises; compared as numbers.

    ``tiles`` has tile_id, xloc and yloc (one row for each tile); more than one epsg is an error.
    """
    if "epsg" in tiles.columns and tiles.select("epsg").distinct().count() > 1:
        raise ValueError("a mosaic needs one epsg")
    corner = tiles.agg(F.min("xloc").alias("_x0"), F.max("yloc").alias("_y1"))
    t = tiles.select("tile_id", "xloc", "yloc").crossJoin(corner)  # one row
    j = pixels.join(t, "tile_id")
    return j.withColumns({"gy": ((F.col("_y1") - F.col("yloc")) * patch + F.col("y")).cast("long"), "gx": ((F.col("xloc") - F.col("_x0")) * patch + F.col("x")).cast("long")}).drop("_x0", "_y1", "xloc", "yloc")


def cube(pixels: DataFrame, tiles: DataFrame, patch: int) -> DataFrame:
    """A constellation's mosaic on the dates that all its tiles have, from (constellation, tile_id, date, y, x, ...)."""
    from tarn.operators.align import on_common_dates

    return mosaic(on_common_dates(pixels, ["constellation"], "tile_id", "date"), tiles, patch)


def target_size(edge: int, source: float, target: float, legacy: bool = False) -> float:
    """Edge in pixels at another resolution; ``legacy`` halves when coarser and doubles when finer."""
    if source == target:
        return edge
    n = edge * source / target
    return n if not legacy else n / 2 if source > target else n * 2


def _targets(df: DataFrame, keys: list[str], size: int, target: int, value: str, reach: float, keep) -> DataFrame:
    """Each pixel of square frames with the target pixels (_y, _x) that it has a part in: ``keep`` of its own and the target's place on an axis.

    ``reach`` is how far, in pixels, targets lie outside a pixel. They are counted up from each pixel
    and not joined to a grid of all frames: Spark takes such a grid for as small as the list of
    frames and would broadcast it, through the driver.
    """
    d = df.select(*keys, "y", "x", value)
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    for c in ("y", "x"):
        first = F.greatest(F.floor((F.col(c) - reach) * target / size - 0.5), F.lit(0)).cast("int")
        last = F.least(F.ceil((F.col(c) + 1 + reach) * target / size - 0.5), F.lit(target - 1)).cast("int")
        d = d.where(F.col(c).between(0, size - 1)).withColumn(f"_{c}", F.explode(F.sequence(first, last))).where(keep(F.col(c), F.col(f"_{c}")))
    return d


def nearest(df: DataFrame, keys: list[str], size: int, target: int, value: str) -> DataFrame:
    """Square frames resized by nearest neighbour. No join, no shuffle."""
    d = _targets(df, keys, size, target, value, 0, lambda own, to: F.floor((to + 0.5) * size / target) == own)
    return d.select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), value)


def bilinear(df: DataFrame, keys: list[str], size: int, target: int, value: str) -> DataFrame:
    """Square frames resized by the four neighbours of each target centre; edges are clamped. No join, one aggregate."""
    at = lambda to: F.least(F.greatest((to + 0.5) * size / target - 0.5, F.lit(0.0)), F.lit(size - 1.0))
    weight = lambda own, to: 1 - F.abs(own - at(to))
    d = _targets(df, keys, size, target, value, 0.5, lambda own, to: weight(own, to) > 0)
    w = weight(F.col("y"), F.col("_y")) * weight(F.col("x"), F.col("_x"))
    return d.groupBy(*keys, F.col("_y").alias("y"), F.col("_x").alias("x")).agg(F.sum(F.col(value) * w).alias(value))


def box_mean(df: DataFrame, keys: list[str], value: str, size: int = 5, out: str = "mean") -> DataFrame:
    """Mean of the full size x size window centred on each pixel, else null: two one-dimensional windows."""
    h = size // 2
    row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-h, h)
    col = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-h, h)
    t = df.withColumns({"_s": F.sum(value).over(row), "_n": F.count(value).over(row)})
    t = t.withColumns({"_t": F.sum("_s").over(col), "_m": F.sum("_n").over(col)})
    return t.withColumn(out, F.when(F.col("_m") == size * size, F.col("_t") / (size * size))).drop("_s", "_n", "_t", "_m")


def chip_index(datasets: DataFrame, height: str, width: str, size: int, keys: list[str]) -> DataFrame:
    """(keys, i, j) of every whole chip of each frame; partial edges are dropped."""
    n = lambda c: F.floor(F.col(c) / size).cast("int")
    d = datasets.where((n(height) > 0) & (n(width) > 0))
    return d.withColumn("i", F.explode(F.transform(F.sequence(F.lit(0), n(height) - 1), lambda k: k * size))).withColumn("j", F.explode(F.transform(F.sequence(F.lit(0), n(width) - 1), lambda k: k * size))).select(*keys, "i", "j")


def grid_offsets(size: int, chip: int, step: int) -> list[int]:
    """Offsets of a step grid whose last chip is moved back to end at the edge."""
    if chip > size:
        raise ValueError("chip larger than frame")
    out = list(range(0, size - chip + 1, step))
    return out if out[-1] == size - chip else [*out, size - chip]


def grid_sampler(frames: DataFrame, size: int, chip: int, step: int) -> DataFrame:
    """Each frame with every offset (i, j) of the grid."""
    o = F.array(*map(F.lit, grid_offsets(size, chip, step)))
    return frames.withColumn("i", F.explode(o)).withColumn("j", F.explode(o))


def _hash(*columns: Column | str) -> Column:
    """60 bits of a digest that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)).cast("binary")), 1, 15), 16, 10).cast("long")


def random_sampler(frames: DataFrame, size: int, chip: int, revisits: int, chips: int, seed: int = 0) -> DataFrame:
    """``revisits`` frames drawn with replacement, ``chips`` random offsets in each; the same for the same seed.

    Every frame has a rank in a hashed order: a prefix sum over hash cells, then a
    rank within the cell, so that frames are never gathered. A draw takes the frame
    of a hashed rank; all have the same chance.
    """
    cols, cells = frames.columns, 4096
    f = frames.withColumn("_h", _hash(*cols, F.lit(seed))).withColumn("_cell", F.pmod("_h", F.lit(cells)))
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most ``cells`` rows
    base = f.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select("_cell", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    f = f.withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", *cols)) - 1)
    pool = f.join(base, "_cell").withColumn("_rank", F.col("_base") + F.col("_r")).drop("_h", "_cell", "_r", "_base")
    n = F.col("draw")
    draws = frames.sparkSession.range(revisits).withColumnRenamed("id", "draw").crossJoin(frames.agg(F.count(F.lit(1)).alias("_n")))  # one row
    draws = draws.where("_n > 0").withColumn("_rank", F.pmod(_hash(n, F.lit(seed + 2)), F.col("_n"))).drop("_n")
    top = size - chip + 1
    out = draws.join(pool, "_rank").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(chips - 1))))
    pick = lambda s: F.pmod(_hash(n, F.col("k"), F.lit(seed + s)), F.lit(top)).cast("int")
    return out.withColumn("i", pick(3)).withColumn("j", pick(4)).drop("_rank")


def crop(df: DataFrame, i: int, j: int, chip: int) -> DataFrame:
    return df.where(F.col("y").between(i, i + chip - 1) & F.col("x").between(j, j + chip - 1))


def label_range(frames: DataFrame, keys: list[str], date: str, delta: int) -> DataFrame:
    """(keys, date, input_date): each label date with itself and the ``delta`` dates before it."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(-delta, 0)
    d = frames.select(*keys, date, F.collect_list(date).over(w).alias("_d"))
    return d.select(*keys, date, F.explode("_d").alias("input_date"))


def worker_share(index: Column, total: int, workers: int, strided: bool = True) -> Column:
    """Worker of a chip by its index: every ``workers``-th, or one run of equal length each."""
    return (F.pmod(index, F.lit(workers)) if strided else F.floor(index / F.lit(-(-total // workers)))).cast("int")
