"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are words, pairs of neighbouring words and pairs with one word between,
lower-cased, without punctuation, hashed to ``2**BITS`` and counted once a text.
Each weight has its own learning rate; the L1 term leaves most weights at zero, so
the model is a short list that can be broadcast. It is fitted, in one task, on a
bounded sample of labelled rows; all texts are then scored where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.text import PUNCTUATION, Words, chunks, mix

BITS = 20
#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
MAX_TRAIN = 15_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
THRESHOLD = 0.5
#: Bias of a model without any labelled row.
UNFITTED = -2.0
_SALTS = (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all texts of ``w``; feature 0 is the bias and is not among them. Repeats remain."""
    n = len(w)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    ids, docs = [w.hash], [doc]
    for gap, salt in ((1, _SALTS[0]), (2, _SALTS[1])):
        if len(doc) > gap:
            same = doc[gap:] == doc[:-gap]
            ids.append(mix(w.hash[:-gap] * salt + w.hash[gap:])[same])
            docs.append(doc[gap:][same])
    f = np.concatenate(ids) >> np.uint64(64 - BITS)
    return np.concatenate(docs), np.maximum(f.astype(np.int64), 1)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features; the bias has no L1."""

    def __init__(self, size: int = 1 << BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, f: np.ndarray) -> np.ndarray:
        z, n = self.z[f], self.n[f]
        l1 = np.where(f == 0, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, f: np.ndarray, y: float) -> None:
        w = self.weights(f)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        s = (np.sqrt(self.n[f] + g * g) - np.sqrt(self.n[f])) / self.alpha
        self.z[f] += g - s * w
        self.n[f] += g * g


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(k, y, text): at most ``limit`` rows with a label whose crc32(id) mod 5 is not 0, in order of a hash of the id."""
    y = labels.select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("y")).where("k is not null and y is not null").where(F.crc32(F.col("k").cast("string").cast("binary")) % 5 != 0)
    y = y.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(limit)
    text = docs.select(F.col("doc_id").alias("k"), "text")
    return text.join(F.broadcast(y), "k").select("k", "y", "text")  # y has at most limit rows of 12 bytes


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) that are not zero, from one task over a bounded sample. Without a labelled row, a low bias alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, float, np.ndarray]] = []
        for b in batches:
            at, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, _, w in chunks(b.column(2), apart=PUNCTUATION):
                doc, f = features(w)
                order = np.argsort(doc, kind="stable")
                first = np.searchsorted(doc[order], np.arange(len(w) + 1))
                for i in range(len(w)):
                    own = np.unique(f[order[first[i] : first[i + 1]]])
                    rows.append((at[lo + i], float(ys[lo + i]), np.r_[0, own].astype(np.int32)))
        if not rows:
            return
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[1], len(r[2])))
        model = Ftrl()
        for _ in range(epochs):
            for _, y, f in rows:
                model.learn(f, y)
        every = np.arange(1 << BITS)
        w = model.weights(every)
        keep = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([keep.astype("<i4").tobytes()]), pa.array([w[keep].astype("<f4").tobytes()])], names=["f", "w"])

    found = labelled(docs, labels, limit).repartition(1).mapInArrow(run, "f binary, w binary").collect()
    if not found:  # nothing to learn from
        return np.zeros(1, "<i4"), np.full(1, UNFITTED, "<f4")
    row = found[0]
    return np.frombuffer(row["f"], "<i4"), np.frombuffer(row["w"], "<f4")


def _logits(column, rows: int, table: np.ndarray) -> np.ndarray:
    """Probability of each text."""
    z = np.full(rows, table[0])
    for lo, hi, w in chunks(column, apart=PUNCTUATION):
        doc, f = features(w)
        hit = np.flatnonzero(table[f])
        pairs = np.unique((doc[hit].astype(np.int64) << BITS) | f[hit])
        z[lo:hi] += np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], hi - lo)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _table(model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[model[0]] = model[1]
    return table


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row.

    Null and empty texts get the bias alone. Null keys are kept, repeated rows
    scored alike, extra columns not carried.
    """
    kind = df.schema[key].simpleString().split(":", 1)[1]
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS pairs of 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(sent.value)
        for b in batches:
            p = _logits(b.column(1), b.num_rows, table)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[key, "score", "predicted"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def keep_clean(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not predict to be toxic, with all their columns."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(sent.value)
        for b in batches:
            yield b.filter(pa.array(_logits(b.column(at), b.num_rows, table) < THRESHOLD))

    return df.mapInArrow(run, df.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
