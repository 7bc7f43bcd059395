"""Exact dedup by skew-safe combining.

Equal texts are found in three stages: within each task, within each of ``SALTS``
shares of a digest's rows, and over the winners of those shares. Every stage
groups by the text itself beside its digest. A text with billions of copies
leaves one row for each task and then one for each salt; no task gathers it. Rows then
find their text's winner by its SHA-256 digest, in a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.text import WS

#: Shares into which the rows of one digest are dealt before the last stage.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, keep_id, group_size) for each distinct normalised text."""
    d = df.select(F.col(key).alias("k"), normalised(F.col(text)).alias("t"))
    d = d.select("k", "t", F.sha2("t", 256).alias("digest"), F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int").alias("salt"))
    shares = d.groupBy("digest", "t", "salt").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    return shares.groupBy("digest", "t").agg(F.min("k").alias("keep_id"), F.sum("n").alias("group_size")).drop("t")


def mark(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to every row.

    The row with the smallest key of equal texts stays; null keys are ignored
    unless all are null (then keep_id is null and every such row is kept).
    Null texts equal empty ones. Rows that repeat the kept key are all marked
    kept. Columns of ``df`` with those names are replaced.
    """
    g = groups(df, key, text, salts).withColumnRenamed("digest", "text_sha256")
    new = ["text_sha256", "keep_id", "group_size", "kept"]
    rows = df.drop(*(c for c in new if c in df.columns)).withColumn("text_sha256", F.sha2(normalised(F.col(text)), 256))
    return rows.join(g, "text_sha256").withColumn("kept", F.coalesce(F.col(key) == F.col("keep_id"), F.col("keep_id").isNull()))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one for each distinct text, with the columns of ``df``."""
    kept = mark(df, key, text).where("kept")
    alone = kept.where("group_size = 1").select(df.columns)
    return alone.unionByName(kept.where("group_size > 1").dropDuplicates(["text_sha256"]).select(df.columns))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    out = mark(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
