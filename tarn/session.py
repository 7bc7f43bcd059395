"""Session with the settings that the library's results rely on."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(app: str = "tarn", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; skewed joins are split and small partitions merged at run time."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that Python functions work wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_tarn_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tarn-"), "tarn_package.zip")  # served to executors by the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tarn", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tarn_shipped = True


def shipped(f):
    """``f`` (session, ...) after ``ship``."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        ship(spark)
        return f(spark, *args)

    return run
