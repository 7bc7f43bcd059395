"""Written tables that cut lineage, and the routing of packed arrays between tasks.

``stash`` writes a DataFrame to the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back, so that a lost executor costs a
reread and not a recomputation of the whole lineage.

A table that later steps do not read any more is removed with ``discard``; what is
left goes when the application ends.

``deal`` sends rows to the partition that their ``bucket`` column names. Many
operators here exchange millions of 64-bit hashes; these travel as byte arrays
(one row for each task and bucket) instead of one row for each hash.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only in local mode, as in tests, a temporary one stands in where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def reclaim(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that shuffle files which only written tables needed are removed now.

    Spark removes a shuffle's files when the driver no longer refers to it, which
    is found out at a collection; until then every step's files pile up. The
    second collection is for what the scheduler still held during the first.
    """
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()


#: Rows between checks of a page's size. Rows of packed arrays can have a megabyte; by default a page takes 100 to
#: 10,000 rows unchecked, and compressors keep direct buffers of a page's size.
PAGE_ROWS = 16
#: Folders of written tables by session, as they are to be removed.
_written: set[str] = set()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as written."""
    spark = df.sparkSession
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all, spark)
    _written.add(path)
    df.write.option("compression", "lz4").option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", PAGE_ROWS).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stash`` returned. Nothing that is still to run may read them."""
    for t in tables:
        path = getattr(t, "_tarn_path", None)
        if path in _written:
            _remove(t.sparkSession, path)
            _written.discard(path)


def _remove_all(spark: SparkSession) -> None:
    """At the end of the driver's process, while its session lives."""
    if spark.sparkContext._jsc is None:
        return
    for path in sorted(_written):
        with contextlib.suppress(Exception):  # the session may be on its way out
            _remove(spark, path)


#: Bytes of input for each bucket of packed arrays.
BUCKET_BYTES = 16 << 20


def buckets(df: DataFrame) -> int:
    """Buckets for packed arrays made from ``df``: in proportion to its size as read, so that a bucket's arrays fit a task, and no fewer than the session's shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < 1 << 62)  # more stands for an unknown size
    least = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(math.ceil(size / BUCKET_BYTES), 1 << 20))


def planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane; of small numbers the upper planes are zeros, which a shuffle's compression removes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def deal(df: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Send each row to partition ``column`` of ``n``: hashes are uniform, so buckets are even."""
    return df.repartitionById(n, F.col(column).cast("int"))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash, rising with the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cuts(sorted_keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for ascending hashes; buckets without a hash are left out."""
    if not len(sorted_keys):
        return []
    which = bucket_of(sorted_keys, n)
    at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    ends = np.r_[at[1:], len(which)]
    return [(int(which[a]), int(a), int(b)) for a, b in zip(at, ends)]


def packed(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit values as ``planes`` of their differences."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)
