import random
import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): random texts, exact and near copies, shared passages, short and empty ones."""
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(900)] + ["É", "ß#", "Stop.", "|"]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    passage, base = some(60), some(120)

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocab)
        return w

    texts = [" ".join(edited(base, r.randint(0, 5))) for _ in range(40)]
    texts += ["\n".join([" ".join(some(r.randint(1, 60))), " ".join(passage), " ".join(some(r.randint(0, 20)))]) for _ in range(40)]
    texts += [" ".join(some(r.randint(1, 80))) for _ in range(60)]
    texts += [r.choice(texts).replace(" ", r.choice(["  ", "\t", " "])) for _ in range(30)]
    texts += ["", " ", "\n\t", None, "one", "A b", "the same " * 40, "x " * 3000]
    r.shuffle(texts)
    return [(i, t, r.choice(["a", "b", "c", None, "a", "a"])) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    """The corpus as Parquet, as the operators get it."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, repeated, long and clashing rows; extra columns named as the operators name theirs."""
    long = " ".join(f"t{i % 5000}" for i in range(60_000))
    rows = [(None, None, None), (None, "", "s"), (None, "a null key with a text of its own here", None), (1, None, "s"), (1, None, "s"), (2, "", "s"), (3, "  \t\n", ""), (4, long, "s"), (5, "Same text " * 12, "s"), (5, "Same text " * 12, "s"), (6, "Same text " * 12, "t"), (7, "one", "t"), (8, "<|endoftext|> ends", "t")]
    names = ["row", "size", "key", "unit", "bucket", "text_sha256", "h", "kept", "node", "label", "score", "copies", "cut", "keep_id", "host", "k", "t", "_k"]
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
