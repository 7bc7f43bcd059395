"""The queries that SQL can express, against their SQL on the smallest tables."""

import pytest

from tarn.llm.queries import QUERIES, SQL
from tests.conftest import SF
from tests.test_queries import duck, table  # noqa: F401


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):  # noqa: F811
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    got = got[list(want.columns)]
    if name == "op2_mixing":  # targets are sums in another order
        assert got.sort_values("doc_id")["target"].tolist() == pytest.approx(want.sort_values("doc_id")["target"].tolist())
        got, want = got.drop(columns="target"), want.drop(columns="target")
    assert table(got) == table(want) and len(got)
