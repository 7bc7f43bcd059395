"""Mixing sources to target weights with a low-discrepancy schedule.

Each source is one endless stream: its documents in a hashed order, repeated.
Golden-ratio points, mapped through the cumulative target shares, name the source
of every slot of the mix; the j-th slot of a source takes the j-th block of its
stream. All blocks of a source have the same number of words, so that its slots
together take its target. Documents are joined to the slots that their words are
in; what the slots take of a document is what the mix takes, and the mixed rows
come slot by slot. A source's position in the stream is a prefix sum over
hash buckets and then within a bucket, so that no task gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.store import buckets, deal, stash
from tarn.llm.text import WORD, WS

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Hash buckets of a source: 16 ** DIGITS. A source of a billion documents has 250,000 in each.
DIGITS = 3
#: Slots of the schedule, at least and for each source; their number does not follow the rows.
SLOTS, SLOTS_PER_SOURCE = 4096, 256
GOLDEN = 0.6180339887498949
#: First slot of the sources that none of the points falls to.
LATE = 1 << 40


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, place, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn. Targets share
    ``share`` times all sizes by weight and stop at ``most`` times their source;
    the excess goes to the others by weight (water filling: the level is the
    greatest of the levels that hold after each source in order of fullness).
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("place", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return s.withColumn("target", F.least("cap", F.col("weight") * F.col("level"))).select("source", "source_size", "place", "target")


def schedule(target: DataFrame) -> DataFrame:
    """(slot, place, rank, from_word, to_word): which words of which source's endless stream fill each slot.

    A point finds its source by the cell that it is in: there are as many cells as
    sources and slots, and a source lists those that its share of the targets covers.
    """
    w = Window.orderBy("place")  # one row for each source
    t = target.withColumn("above", F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"below": F.coalesce(F.lag("above").over(w), F.lit(0.0)), "all": F.max("above").over(everything), "n": F.count(F.lit(1)).over(everything) * SLOTS_PER_SOURCE + SLOTS})
    cell = lambda v: F.least(F.floor(F.try_divide(F.col(v) * F.col("n"), F.col("all"))), F.col("n") - 1)
    shares = t.where("target > 0").select("place", "below", "above", "all", F.explode(F.sequence(cell("below"), cell("above"))).alias("cell"))
    grid = t.agg(F.max("n").alias("n"), F.max("all").alias("all")).select("n", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    grid = grid.withColumn("x", F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0)) * F.col("all")).select("slot", "x", cell("x").alias("cell"))
    # the last point may round to the sum of the targets
    inside = (F.col("x") >= F.col("below")) & ((F.col("x") < F.col("above")) | (F.col("above") == F.col("all")))
    grid = grid.join(shares, "cell").where(inside).select("slot", "place")
    # a source too small for any of the points still gets a slot, after the others
    count = grid.groupBy("place").agg(F.count("*").alias("slots"))
    t = target.join(count, "place", "left")
    missed = t.where("slots is null and target > 0").select((F.col("place") + LATE).cast("long").alias("slot"), "place")
    ranked = grid.unionByName(missed).withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("slot")) - 1)
    t = t.select("place", F.round("target").cast("long").alias("words"), F.coalesce("slots", F.lit(1)).alias("slots"))
    cut = lambda r: F.expr(f"words * ({r}) div slots")
    return ranked.join(t, "place").select("slot", "place", "rank", cut("rank").alias("from_word"), cut("rank + 1").alias("to_word"))


def _streamed(df: DataFrame, key: str, text: str, source: str, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every row's place in its source's stream, and the schedule. ``carry`` adds the whole row as ``row``.

    The row's words are ``[begin, begin + size)`` of each pass over its source; ``words`` of the endless stream
    are taken, in ``slots`` slots.
    """
    own = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if carry else []
    d = df.select(*own, F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")).cast("binary")).alias("h"), F.xxhash64(F.col(text)).alias("x"))
    d = d.withColumn("bucket", F.substring("h", 1, DIGITS))
    sizes = stash(d.drop("row"), "mix-sizes")  # words are counted once
    d = d if carry else sizes
    t = stash(targets(sizes), "targets")  # one row for each source
    plan = stash(schedule(t), "schedule")  # SLOTS_PER_SOURCE rows for each source, and SLOTS
    total = plan.groupBy("place").agg(F.max("to_word").alias("words"), F.count("*").alias("slots"))
    t = t.join(total, "place", "left").select(F.col("source").alias("s_source"), "place", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("words"), "slots")
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    sums = sums.join(t, F.col("source").eqNullSafe(F.col("s_source"))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "place", "base", "source_size", "target", "words", "slots")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    d = d.withColumn("inside", inside)
    d = d.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    begin = (F.col("base") + F.col("inside")).cast("long").alias("begin")
    return d.select(*(["row"] if carry else []), "doc_id", "source", "size", "place", "source_size", "target", "words", "slots", begin), plan


def _passes(d: DataFrame) -> DataFrame:
    """A row for each pass that takes words of a document: ``[at, until)`` of its source's endless stream."""
    d = d.where("size > 0 and begin < words")
    d = d.withColumn("at", F.explode(F.expr("transform(sequence(0L, (words - begin - 1) div source_size), p -> p * source_size + begin)")))
    return d.withColumn("until", F.least(F.col("at") + F.col("size"), F.col("words")))


def _rank(word: str) -> Column:
    """Rank of the slot of its source that a word of the endless stream is in: the last with ``words * rank div slots <= word``."""
    return F.expr(f"(({word}) * slots + slots - 1) div words")


def _dealt(d: DataFrame, plan: DataFrame) -> DataFrame:
    """The parts of ``_passes`` by slot, ``taken`` words of each."""
    d = _passes(d).withColumn("rank", F.explode(F.sequence(_rank("at"), _rank("until - 1"))))
    return d.join(plan, ["place", "rank"]).withColumn("taken", F.least("until", "to_word") - F.greatest("at", "from_word"))


def dealt(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(slot, doc_id, source, at, taken): the documents of each slot, with the words that the slot takes of them and where these begin in the endless stream of their source."""
    return _dealt(*_streamed(df, key, text, source)).select("slot", "doc_id", "source", F.greatest("at", "from_word").alias("at"), "taken")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, cut, taken): what the slots take of every row.

    ``copies`` whole passes over the document and ``cut`` of its first words once
    more make ``taken``. Null texts and texts without words have size 0 and are
    taken 0 times; a null source is a source of its own; rows with a null key are
    placed by their text. Repeated rows are documents of their own; rows that repeat
    a key are ordered by size and text, so that reruns agree. Extra columns are not
    carried, whatever their names; an empty table gives no row. Of a text only the
    number of its words counts, however long it is.
    """
    d, plan = _streamed(df, key, text, source)
    # begin tells the documents of a source apart that have words
    own = ["doc_id", "source", "size", "source_size", "target", "begin"]
    some = _dealt(d, plan).groupBy(own).agg(F.sum("taken").alias("taken"))
    none = d.where("size = 0 or begin >= words").select(*own, F.lit(0).cast("long").alias("taken"))
    d = some.unionByName(none)
    return d.select(*own[:-1], F.expr("coalesce(taken div nullif(size, 0), 0L)").alias("copies"), F.expr("coalesce(taken % nullif(size, 0), 0L)").alias("cut"), "taken")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix in the order of the schedule, with the columns of ``df``.

    Each row is there as often as the mix takes it, and where a target ends inside
    a document its first words once more, joined by single spaces. A document that
    several slots share stays whole, in the slot that it begins in. Partitions are
    ranges of slots, sorted. Rows without words are not in the mix. Null sources,
    null and repeated keys as in ``mix``; extra columns are carried, whatever their
    names; an empty table gives no row.
    """
    d, plan = _streamed(df, key, text, source, carry=True)
    n = buckets(df)
    m = _passes(d).withColumn("rank", _rank("at")).join(plan.select("place", "rank", "slot"), ["place", "rank"])
    # slots take about as many words each; those after the others go last
    last = plan.where(F.col("slot") < LATE).agg(F.max("slot") + 1)
    m = m.withColumn("range", F.least(F.floor(F.col("slot") * n / last.scalar()), F.lit(n - 1)).cast("int"))
    m = deal(m.select("row", "range", "slot", "at", (F.col("until") - F.col("at")).alias("cut"), "size"), n, "range").sortWithinPartitions("slot", "at")
    part = F.array_join(F.slice(F.filter(F.split(f"row.{text}", WS), lambda w: w != ""), 1, F.col("cut").cast("int")), " ")
    now = F.when(F.col("cut") == F.col("size"), F.col(f"row.{text}")).otherwise(part)
    return m.select(*(now.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS begin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN (words // source_size) * size + greatest(0, least(size, words % source_size - begin)) ELSE 0 END AS taken
FROM p
"""
