"""Corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from tarn.llm.store import stash
from tarn.session import ship, shipped

#: Column that tells the rows of a stage apart.
ROW = "_tarn_row"


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The classifier learns from the labelled documents that are not held out.

    Null and empty texts get the bias alone and stay; repeated rows and ids are
    judged by their own text; without labels nothing goes.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays; null texts equal empty ones.

    Rows without an id stay only where no row with the text has one, and then one of them.
    """
    return exact_dedup.dedup(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, one row stays: that with the smallest id, rows without an id last.

    Rows are told apart by their place in the files they are read from, so that
    repeated and missing ids do no harm. A row without words is linked with none
    and stays. A DataFrame that is not read from files is written first.
    """
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        rows = docs.withColumn(ROW, place)
    except AnalysisException:
        rows = stash(docs, "rows").withColumn(ROW, place)
    groups = jaccard_join.classes(rows, key=ROW).select(F.col(ROW).alias("_r"), "component_id")
    ids = rows.select(ROW, F.col("doc_id").isNull().alias("_none"), "doc_id")
    kept = ids.join(groups, F.col(ROW) == F.col("_r")).groupBy("component_id").agg(F.min(F.struct("_none", "doc_id", ROW)).alias("_k"))
    return rows.join(kept.select(F.col(f"_k.{ROW}").alias("_kept")), F.col(ROW) == F.col("_kept"), "left_semi").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, slot by slot; rows without words are in no mix. A null source is a source."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; the last stage. Null and empty texts would be one id; rows that repeat an id are documents of their own."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar), ("mixing sources", mixed), ("packing", packed)]
STAGES = [(name, shipped(stage)) for name, stage in STAGES]

#: Not expressible in SQL: a fitted classifier, a tokeniser and an online packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them a table is written and read again. Extra columns are carried up to the packing; an empty table gives no row."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
