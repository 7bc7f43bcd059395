"""Every registered query against its SQL on the smallest tables; and the entry point."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as e
from tarn.queries import QUERIES, SQL
from tests.conftest import SF


#: Without a row in the smallest tables.
EMPTY = {"asset_revisits", "tile_containment"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(v)
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v) + 0.0)
    return str(v).replace(" 00:00:00", "")


def table(df):
    d = df[sorted(df.columns)].astype(object)
    return list(d.columns), sorted(tuple(cell(v) for v in r) for r in d.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).df()
    # an integer column with nulls is one of floats in pandas
    for c in got.columns:
        if got[c].dtype != want[c].dtype and {got[c].dtype.kind, want[c].dtype.kind} <= set("iuf") and "f" in {got[c].dtype.kind, want[c].dtype.kind}:
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    (c1, a), (c2, b) = table(got), table(want)
    assert c1 == c2 and len(a) == len(b)
    assert a or name in EMPTY
    # sums in another order may round a last digit apart; integers are equal
    close = lambda p, q: "." in p and "." in q and abs(float(p) - float(q)) <= 1e-6 * max(1, abs(float(p)))
    for x, y in zip(a, b, strict=True):
        assert all(p == q or close(p, q) for p, q in zip(x, y, strict=True))


def test_entry(spark):
    out = e.entry(spark)
    assert out.columns == ["area_id", "constellation", "date", "area"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
