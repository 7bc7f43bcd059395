"""Classifiers by name, and forecasting of a series' next steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import pixel
from tarn.operators import chips, frames, rules


def ndvi(df: DataFrame, **_) -> DataFrame:
    return df.withColumn("ndvi", pixel.ndvi(F.col("nir"), F.col("red")))


def soil_moisture(df: DataFrame, keys: list[str] | None = None, **_) -> DataFrame:
    """Dual-polarised index from 5 x 5 means of vv and vh; edges are null."""
    keys = keys or ["date"]
    d = chips.box_mean(chips.box_mean(df, keys, "vv", 5, "_c11"), keys, "vh", 5, "_c22")
    return d.withColumn("dprvic", pixel.dprvic(F.col("_c11"), F.col("_c22"))).drop("_c11", "_c22")


def cloud_mask(df: DataFrame, constellation: str = "sentinel-2", **_) -> DataFrame:
    """Landsat: quality word with high cloud confidence. Sentinel-2: a decision tree's cloud class on reflectances."""
    if constellation.startswith("landsat"):
        return df.withColumn("cloud", pixel.high_confidence(F.col("bqa"), 8).cast("int"))
    if constellation == "sentinel-2":
        return df.withColumn("cloud", (rules.tree_class(rules.TREES["tree1"]) == 3).cast("int"))
    raise ValueError(f"no cloud mask for {constellation!r}")


#: name -> DataFrame function.
MODELS: dict[str, Callable[..., DataFrame]] = {
    "pekel": lambda df, constellation="sentinel-2", polygons=None, **_: rules.classify_water(df, constellation, polygons),
    "cloud_mask": cloud_mask,
    "ndvi": ndvi,
    "soil_moisture": soil_moisture,
    "cnn": lambda df, scorer=None, keys=None, **_: frames.scored(df, scorer, keys or ["chip_id"]),
}


def model(name: str) -> Callable[..., DataFrame]:
    """A classifier; an unknown name is a KeyError."""
    return MODELS[name]


def forecast(train: DataFrame, test: DataFrame, features: list[str], target: str, kind: str = "gbt", **params) -> tuple[DataFrame, float]:
    """Predictions for ``test`` and their mean squared error, by a tree ensemble."""
    vec = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    learner = {"gbt": GBTRegressor, "rf": RandomForestRegressor}[kind](featuresCol="_x", labelCol=target, predictionCol="prediction", seed=0, **params)
    fitted = learner.fit(vec.transform(train.dropna(subset=[*features, target])))
    out = fitted.transform(vec.transform(test.dropna(subset=features))).drop("_x")
    return out, RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mse").evaluate(out.dropna(subset=[target]))
