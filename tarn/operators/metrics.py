"""Scores of predictions against truth. In every pair the first argument is the prediction.

Multi-class scores come from one confusion matrix, which is as small as the number
of classes squared, so the pixels are read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision(a: Column, b: Column) -> Column:
    return F.try_divide(F.sum(a * b), F.sum(a))


def recall(a: Column, b: Column) -> Column:
    return F.try_divide(F.sum(a * b), F.sum(b))


def accuracy(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("double"))


def iou(a: Column, b: Column) -> Column:
    return F.try_divide(F.sum(a * b), F.sum(a) + F.sum(b) - F.sum(a * b))


def dice(a: Column, b: Column) -> Column:
    return F.try_divide(2 * F.sum(a * b), F.sum(a) + F.sum(b))


def pearson(a: Column, b: Column) -> Column:
    return F.corr(a, b)


def mse(a: Column, b: Column) -> Column:
    return F.avg((a - b) * (a - b))


def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def r2(a: Column, b: Column) -> Column:
    """1 - residual over total sum of squares of the truth ``b``."""
    return 1 - F.try_divide(F.sum((b - a) * (b - a)), F.count(F.lit(1)) * F.var_pop(b))


METRICS = {"precision": precision, "recall": recall, "accuracy": accuracy, "iou": iou, "dice": dice, "pearson": pearson, "mse": mse, "mae": mae, "r2": r2}


def evaluate(df: DataFrame, pred: str, truth: str, metrics: list[str] | dict, keys: list[str] | None = None) -> DataFrame:
    """Named metrics, or a dict of name to function of two Columns, for each key."""
    if isinstance(metrics, (list, tuple)):
        metrics = {m: METRICS[m] for m in metrics}
    if not isinstance(metrics, dict):
        raise ValueError("metrics must be names or a dict")
    aggs = [f(F.col(pred), F.col(truth)).alias(n) for n, f in metrics.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def confusion(df: DataFrame, pred: str, truth: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """precision, recall, f1, iou and dice of each class against the rest, over classes of either side."""
    m = confusion(df, pred, truth)
    side = m.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), F.col("n"), (F.col("truth") == F.col("pred")).cast("int").alias("hit"))
    s = side.groupBy(F.col("s.class").alias("class")).agg(F.sum(F.col("n") * F.col("s.p")).alias("predicted"), F.sum(F.col("n") * F.col("s.t")).alias("actual"), F.sum(F.col("n") * F.col("hit") * F.col("s.t")).alias("both"))
    both, p, t = F.col("both"), F.col("predicted"), F.col("actual")
    return s.select("class", F.try_divide(both, p).alias("precision"), F.try_divide(both, t).alias("recall"), F.try_divide(2 * both, p + t).alias("f1"), F.try_divide(both, p + t - both).alias("iou"))


def single_class(df: DataFrame, pred: str, truth: str, cls: int = 1, keys: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 and iou of one class; null for each key whose truth lacks it."""
    p, t = (F.col(pred) == cls).cast("int"), (F.col(truth) == cls).cast("int")
    scores = {"precision": precision(p, t), "recall": recall(p, t), "f1": dice(p, t), "iou": iou(p, t)}
    aggs = [F.when(F.max(t) == 1, c).alias(n) for n, c in scores.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def harness(truth: DataFrame, masks: DataFrame | None, on: list[str], value: str, metrics: list[str] | dict, keys: list[str], predict=None) -> DataFrame:
    """``suite`` of every area against stored masks or, where ``predict`` is given, against fresh predictions of ``truth``'s pixels."""
    if (masks is None) == (predict is None):
        raise ValueError("either stored masks or a predictor")
    return suite(predict(truth) if predict else masks, truth, on, value, metrics, keys)


def same_pixels(pred: DataFrame, truth: DataFrame, on: list[str]) -> None:
    """AssertionError unless both sides have the same keys."""
    a, b = pred.select(*on, F.lit(1).alias("_a")), truth.select(*on, F.lit(1).alias("_b"))
    if not a.join(b, on, "full_outer").where("_a is null or _b is null").isEmpty():
        raise AssertionError("prediction and truth differ in shape")


def suite(pred: DataFrame, truth: DataFrame, on: list[str], value: str, metrics: list[str] | dict, keys: list[str]) -> DataFrame:
    """Metrics for each key over pixels that both sides have."""
    j = pred.select(*on, F.col(value).alias("_p")).join(truth.select(*on, F.col(value).alias("_t")), on)
    return evaluate(j, "_p", "_t", metrics, keys)
