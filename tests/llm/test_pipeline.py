"""The pipeline's stages against brute-force versions of each."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tarn.llm import mixing, toxicity
from tests.llm.conftest import words
from tests.llm.test_operators import links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        out.append((name, before, docs))
    return out


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages(spark, stages):
    columns = stages[0][1].columns
    for _, _, after in stages[:-1]:
        assert after.columns == columns
    rows = [(n, b.collect(), a.collect()) for n, b, a in stages]
    model = toxicity.fit(stages[0][1], spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(stages[0][1], model).collect() if r.predicted}
    assert {r.doc_id for r in rows[0][2]} == {r.doc_id for r in rows[0][1]} - bad
    first = {}
    for r in sorted(rows[1][1], key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r)
    assert sorted(rows[1][2]) == sorted(first.values())
    comp = links([(r.doc_id, r.text) for r in rows[2][1]])
    assert sorted(rows[2][2]) == sorted(r for r in rows[2][1] if comp[r.doc_id][1] == r.doc_id)
    taken = {r.doc_id: r for r in mixing.mix(stages[3][1]).collect()}
    got, before = defaultdict(list), {r.doc_id: r for r in rows[3][1]}
    for r in rows[3][2]:
        got[r.doc_id].append(r)
    assert all(sum(len(words(r.text)) for r in got[i]) == t.taken for i, t in taken.items())
    for i, copies in got.items():  # whole copies and at most one cut
        w = words(before[i].text)
        cut = [r for r in copies if r.text != before[i].text]
        assert len(cut) <= 1 and all(words(r.text) == w[: len(words(r.text))] for r in cut)
        assert len(copies) - len(cut) == taken[i].copies
        assert all(r[:1] + r[2:] == before[i][:1] + before[i][2:] for r in copies)
    check(rows[4][2], [(r.doc_id, r.text) for r in rows[3][2]])


def check(pieces, documents):
    """Every document's ids lie in pieces without a gap, sequences are gapless and of at most 1024 ids, and only powers of two are shorter."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, sequences = Counter(), Counter(), defaultdict(list)
    for i, t in documents:
        want[i, len(exact.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    for r in pieces:
        got[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    check(got, [(r.doc_id, r.text) for r in stages[-1][1].collect()])
    # the same documents, packed in another deal of rows to tasks
    assert sum(r.length for r in got) == sum(r.length for r in stages[-1][2].collect())


def test_dissimilar_tells_rows_apart(spark):
    w = [f"w{i}" for i in range(100)]
    near = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    other = " ".join(f"y{i}" for i in range(50))
    rows = [(5, near()), (5, near(3)), (7, other), (5, other + " z"), (None, near(9)), (None, "alone and away from all of the others here"), (None, None), (None, other + " q"), (9, ""), (9, "")]
    out = corpus_pipeline.dissimilar(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert Counter(r.doc_id for r in out if r.text and "alone" not in r.text) == {5: 2}
    assert len([r for r in out if r.text in (near(), near(3))]) == 1 and [r.text for r in out if r.text and r.text.startswith("y")] == [other + " z"]
    assert Counter((r.doc_id, r.text) for r in out if not r.text or "alone" in r.text) == {(9, ""): 2, (None, None): 1, (None, rows[5][1]): 1}
