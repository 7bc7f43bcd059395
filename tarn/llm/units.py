"""Units: blocks of input rows that ask the rest of the corpus about their own hashes.

A unit is a block of consecutive rows of one file, whichever tasks read it, so that
a rerun after a loss, or with other splits, deals the same rows to the same units.
The units of a file have consecutive numbers and are dealt to tasks in turn, which
is more even than by a hash of each.
The rows of a block are of one class of length, and the longer they are, the fewer
are in a block: a unit has less than ``ROWS * SHORT`` bytes, or is one row. A unit
sends each bucket the distinct hashes it holds; the bucket
answers every unit in the order of the hashes sent; the answers then meet the
unit's rows in one shuffle by unit. What travels is the distinct hashes of units,
in packed arrays, and never an occurrence or a hot key for each of its rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.store import deal, stash

#: Rows of a unit whose texts have at most ``SHORT`` bytes. Each next class of texts is 16 times as long, in blocks of a 16th of the rows.
ROWS, SHORT = 1024, 1 << 14
#: Units that a task gathers at once; those of longer classes lie among the rows of shorter ones.
_OPEN = 4


def with_unit(df: DataFrame, columns: list[Column | str], text: str) -> DataFrame:
    """``columns`` and ``unit`` (long). A DataFrame that is not read from files is written first, with the column ``text``."""

    def unit(c: str) -> Column:
        size = F.coalesce(F.octet_length(F.col(c)), F.lit(0))
        rows = F.when(size <= SHORT, ROWS).when(size <= SHORT * 16, ROWS // 16).when(size <= SHORT * 256, ROWS // 256).otherwise(1)
        # shifted, so that the number of the block is added without overflow
        return (F.shiftright(F.xxhash64(F.col("_metadata.file_path"), rows), 2) + F.floor(F.col("_metadata.row_index") / rows)).alias("unit")

    try:
        return df.select(unit(text), *columns)
    except AnalysisException:
        return stash(df.select(*columns, F.col(text).alias("_text")), "units").select(unit("_text"), "*").drop("_text")


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows with the same value in the first column, which come in runs that a few others may interrupt."""
    held: OrderedDict[int, list[pa.RecordBatch]] = OrderedDict()
    for b in batches:
        if not b.num_rows:
            continue
        u = b.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(u, kind="stable")
        starts = np.flatnonzero(np.r_[True, u[order][1:] != u[order][:-1]])
        parts = [order[s:e] for s, e in zip(starts, np.r_[starts[1:], len(u)], strict=True)]
        for at in sorted(parts, key=lambda x: int(x[0])):
            k = int(u[at[0]])
            whole = at[-1] - at[0] + 1 == len(at)
            held.setdefault(k, []).append(b.slice(int(at[0]), len(at)) if whole else b.take(pa.array(at)))
            held.move_to_end(k)
            if len(held) > _OPEN:
                oldest, rows = held.popitem(last=False)
                yield oldest, pa.Table.from_batches(rows)
    for k, rows in held.items():
        yield k, pa.Table.from_batches(rows)


def grouped(df: DataFrame, tasks: int):
    """``df`` grouped by unit, for ``cogroup``: both sides are dealt alike, into so many tasks. Blocks of a file follow each other's tasks in turn."""
    return deal(df.withColumn("task", F.pmod("unit", F.lit(tasks)).cast("int")), tasks, "task").groupBy("task", "unit")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and how often each occurs."""
    s = np.sort(keys)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.r_[at, len(s)])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of (keys, numbers) pairs and the sums of their numbers."""
    keys, numbers = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(numbers[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
