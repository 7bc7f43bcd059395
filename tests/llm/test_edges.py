"""Null, empty, repeated, long and clashing rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, jaccard_join, lm, mixing, packing, quality, sharding, substring_dedup, toxicity, url_filters
from tarn.llm.components import components


def calls(spark):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (None, 0, 1), (7, 0, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "url": lambda d: url_filters.judge(d, "text"),
        "mix": mixing.mix,
        "mixed": mixing.mixed,
        "lm": lambda d: lm.score(d, F.col("doc_id") > 2),
        "pack": packing.pack,
        "join": jaccard_join.classes,
        "toxic": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "clean": lambda d: toxicity.keep_clean(d, toxicity.fit(d, labels)),
        "quality": quality.measure,
        "shard": sharding.shard,
        "exact": exact_dedup.mark,
        "dedup": exact_dedup.dedup,
        "substring": substring_dedup.dedup,
    }


NAMES = ["url", "mix", "mixed", "lm", "pack", "join", "toxic", "clean", "quality", "shard", "exact", "dedup", "substring"]
PER_ROW = {"url", "mix", "lm", "join", "toxic", "quality", "shard", "exact", "substring"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    out = calls(spark)[name](odd).collect()
    if name in PER_ROW:
        assert len(out) == odd.count()
    if name == "join":
        by = {r.doc_id: r for r in out if r.doc_id is not None}
        assert by[5].component_id == 5 and by[6].component_id == 5 and by[2].component_id == 2 and by[2].n_shingles == 0
    if name == "exact":
        assert {r.keep_id for r in out if r.doc_id in (5, 6)} == {5}
        assert {r.keep_id for r in out if r.text is None or r.text == ""} == {1}
    if name == "dedup":
        assert sum(r.text is not None and r.text.startswith("Same") for r in out) == 1
    if name == "pack":
        assert sum(r.length for r in out if r.doc_id == 2) == 1
        assert 50256 in [int.from_bytes(r.ids[k : k + 4], "little") for r in out if r.doc_id == 8 for k in range(0, len(r.ids), 4)]
    if name == "substring":
        long = next(r for r in out if r.doc_id == 4)
        assert long.n_words == 60_000 and long.n_removed == 55_000
        assert sorted(r.n_removed for r in out if r.doc_id in (5, 6))[:1] != [24]
    if name == "mixed":
        assert set(odd.columns) == set(out[0].asDict())


@pytest.mark.parametrize("group", [jaccard_join.GROUP, 2])
def test_join_links_rows_without_id(spark, group):
    w = [f"w{i}" for i in range(100)]
    near = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    # 1 and 2 are linked only through the text without an id
    rows = [(1, near(5, 25)), (None, near()), (None, near()), (2, near(75, 95)), (None, "alone " + near(*range(40))), (None, " ".join(f"y{i}" for i in range(60))), (None, " ".join(f"y{i}" for i in range(61)))]
    out = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in out if r.component_id is not None) == [(False, 1, 1), (False, 2, 1), (True, None, 1), (True, None, 1)]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, name, tmp_path):
    odd.limit(0).write.parquet(str(tmp_path / "none"))
    assert calls(spark)[name](spark.read.schema(odd.schema).parquet(str(tmp_path / "none"))).collect() == []


def test_components(spark):
    import random

    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score(odd, toxicity.fit(odd, none)).collect()
    assert len(out) == odd.count() and not any(r.predicted for r in out)
