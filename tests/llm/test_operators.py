"""Each operator against a brute-force version on a small corpus."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, jaccard_join, lm, mixing, packing, quality, sharding, substring_dedup, toxicity, url_filters
from tests.llm.conftest import words


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_url_filters(spark):
    urls = ["http://a.net/x", "https://WWW.Example.NET/en/1?q", "http://example.net/EN/1", "http://b.example.com/de/", "http://example.com/de", "http://x.org/fr/", "http://org/fr/a", "http://notnet/", "nothing", None, "http://a.net", "http://a.net?x/", "http://casino-win.example.org/", "http://mycasino.com/", "ftp://net/#x", "x://y://net/", "http://fr.org/a/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_filters.judge(df), "page_id")
    contract = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), v, h + p) for v, h, p in contract if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path) == (host, path), u
        if fits:
            assert (r.verdict, r.rule) == max(fits)[1:], u
        else:
            assert r.rule is None or r.rule.startswith("~")
            assert r.verdict == ("block" if u and "casino-win" in u else "allow"), u


def test_url_index_reads_few_rules(spark):
    rules = [url_filters.prefix_rule("block", f"site{i}.example/") for i in range(500)]
    df = spark.createDataFrame([(1, "http://a.site7.example/x"), (2, "http://site8.other/")], "page_id long, url string")
    got = rows(url_filters.judge(df, rules=rules), "page_id")
    assert got[1].rule == "site7.example/" and got[1].candidates <= 2 and got[2].rule is None


def test_url_rules_beyond_the_plan(spark):
    """Many rules are joined, with the same verdicts as in the plan; line breaks do not hide a host's word."""
    rules = [url_filters.prefix_rule("block" if i % 3 else "allow", f"site{i}.example/{'ab'[i % 2]}") for i in range(20_000)] + url_filters.default_rules()
    urls = [f"http://{'ABC'[i % 3]}.site{i * 7}.example/{'ab'[i % 3 % 2]}/x" for i in range(1000)] + ["http://casino.x/a\nb", "http://casino.x", "http://x.y/casino", None, "no url", "http://net/"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    many, few = rows(url_filters.judge(df, rules=rules), "page_id"), rows(url_filters.judge(df), "page_id")
    for i, u in enumerate(urls[:1000]):
        k = i * 7
        fits = k < 20_000 and "ab"[i % 3 % 2] == "ab"[k % 2]
        assert (many[i].rule, many[i].verdict) == ((f"site{k}.example/{'ab'[k % 2]}", "block" if k % 3 else "allow") if fits else (None, "allow"))
        assert many[i].candidates <= 2
    assert all(many[i] == few[i] or many[i].candidates >= few[i].candidates and many[i].rule == few[i].rule for i in range(1000, len(urls)))
    assert [few[i].verdict for i in range(1000, 1006)] == ["block", "block", "allow", "allow", "allow", "block"]


def test_mixing(docs, corpus):
    got = rows(mixing.mix(docs))
    size = {i: len(words(t)) for i, t, _ in corpus}
    by = defaultdict(int)
    for i, _, s in corpus:
        by[s] += size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(by.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * by[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = defaultdict(int)
    for i, _, s in corpus:
        assert got[i].size == size[i] and got[i].source_size == by[s] and got[i].taken <= 2 * size[i]
        assert got[i].target == pytest.approx(target[s])
        taken[s] += got[i].taken
    for s in by:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    assert sum(len(words(r.text)) for r in again.collect()) == sum(taken.values())


def test_mixed_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 7) if i % 50 else None, "abc"[i * i % 3] if i % 11 else None) for i in range(3000)], "doc_id long, text string, source string")
    parts = mixing.dealt(docs).collect()
    taken = Counter()
    for r in parts:
        assert r.taken > 0
        taken[r.doc_id] += r.taken
    got = rows(mixing.mix(docs))
    assert {i: r.taken for i, r in got.items() if r.taken} == taken
    # the parts of a source, slot by slot, are its stream without a gap
    at = Counter()
    for r in sorted(parts, key=lambda r: (r.slot, r.at)):
        assert r.at == at[r.source]
        at[r.source] += r.taken
    mixed, there = mixing.mixed(docs).collect(), Counter()
    for r in mixed:
        there[r.doc_id] += len(words(r.text))
    assert there == taken
    # any stretch of the rows has each source's share
    share = Counter()
    for r in got.values():
        share[r.source] += r.taken / sum(taken.values())
    c, n = Counter(), 0
    for r in mixed:
        c[r.source] += len(words(r.text))
        n += len(words(r.text))
        assert all(abs(c[s] - n * p) < 60 for s, p in share.items())


def test_schedule_is_spread(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000)], "source string, size long")
    s = mixing.schedule(mixing.targets(sizes)).orderBy("slot").collect()
    t = {r.place: r.target for r in mixing.targets(sizes).collect()}
    for n in (100, 1000, len(s)):
        c = Counter(r.place for r in s[:n])
        for p in t:
            assert abs(c[p] - n * t[p] / sum(t.values())) <= 6


@pytest.mark.parametrize("order", [1, lm.ORDER, 3])
def test_lm_scoring(docs, corpus, order):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = rows(lm.score(docs, train, order=order))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c, after = Counter(), Counter()  # n-grams; and how often a history was followed by a word
    for i, t, _ in corpus:
        if not held(i):
            x = [0, *words(t, True), None]
            for k in range(1, order + 1):
                for at in range(len(x) - k + 1):
                    if k > 1 or at:
                        c[tuple(x[at : at + k])] += 1
                        after[tuple(x[at : at + k - 1])] += 1
    single = {k: v for k, v in c.items() if len(k) == 1}
    n, v = sum(single.values()), len(single)
    once, twice = sum(k == 1 for k in single.values()), sum(k == 2 for k in single.values())
    d = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))

    def p(h, w):
        if not h:
            return (c[w,] - d) / n if c[w,] else d * v / n
        return (c[(*h, w)] + lm.MU * p(h[1:], w)) / (after[h] + lm.MU)

    for i, t, _ in corpus:
        x = [0, *words(t, True), None]
        score = sum(math.log10(p(tuple(x[max(0, k - order + 1) : k]), x[k])) for k in range(1, len(x)))
        base = sum(math.log10((c[w,] + 1) / (n + v + 1)) for w in x[1:])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(x) - 1, sum(c[w,] > 0 for w in x[1:]), n)
        assert r.score == pytest.approx(score, abs=1e-6) and r.base_score == pytest.approx(base, abs=1e-6)


def test_lm_segments_and_wide_counts():
    """Segments of any length give the same scores, and counts beyond 32 bits are kept."""
    import pyarrow as pa

    texts = ["a b a b c", "", "b a", " ".join("abcde"[k * k % 5] for k in range(40))]
    t, first = lm.tokens(pa.array(texts))
    levels = lm.ngrams(t, first, 3)
    counts = [np.unique(h[h != 0], return_counts=True)[1].astype(np.int64) for h in levels]
    counts[1][::3] = 0
    counts[2][::2] = 0
    a = lm.Automaton(levels, first, counts, len(t), len(counts[0]), 0.5, 2.0)
    whole = a.read(first, 3, 1 << 20)
    for segment in (2, 3, 7):
        assert a.read(first, 3, segment) == pytest.approx(whole)
    many = np.array([0, 1, 2**32 - 1, 2**32 + 5, 2**50], np.int64)
    assert np.array_equal(lm.unplanes(lm.planes(many)).astype(np.int64), many)
    sent = {"unit": 1, "bucket": 0, "level": 0, "keys": lm.packed(np.array([7, 9], np.uint64)), "counts": lm.planes(np.array([2**32 - 1, 3]))}
    batch = pa.RecordBatch.from_pylist([sent, sent | {"unit": 2}], pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))
    for r in [r for b in lm._answer([batch]) for r in b.to_pylist()]:
        assert lm.unplanes(r["counts"]).tolist() == [2 * (2**32 - 1), 6]


def check_pieces(pieces, texts, window=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, seq, waste = defaultdict(list), defaultdict(list), 0
    for r in pieces:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        waste += 0 if at & (at - 1) == 0 else window - at
    return waste


def test_packing(docs, corpus):
    pieces = packing.pack(docs).collect()
    assert check_pieces(pieces, {i: t for i, t, _ in corpus}) == 0


@pytest.mark.parametrize(("most", "window"), [(3, 32), (40, 32), (4096, 32), (4096, 100)])
def test_packer_chooses_least_squares(most, window):
    """Every placement, to the end, has the least sum of squares of all that are possible; no id is lost."""
    rng = np.random.default_rng(3)
    p, sent = packing.Packer(window, most), {}
    for i in range(1500):
        n = int(rng.integers(1, 3 * window)) if i % 10 == 0 else int(rng.integers(1, window))
        before = Counter({k: int(c) for k, c in enumerate(p.counts[:window]) if c})
        sent[i], rest, closed = np.arange(n, dtype=np.uint32) + 7 * i, n % window, len(p.done)
        p.add(i, sent[i])
        after = Counter({k: int(c) for k, c in enumerate(p.counts[:window]) if c})
        squares = lambda c: sum(v * v for v in c.values())
        if rest and not any(x[6] == "strung" for x in p.done[closed:]) and sum(before.values()) < most:
            choices = [before + Counter({rest: 1}), *((before - Counter({s: 1})) + Counter({k: 1 for k in [s + rest] if k < window}) for s in before if s + rest <= window)]
            assert squares(after) == min(map(squares, choices))
        assert p.n_open == sum(after.values()) <= max(most, window)
    p.flush()
    got = defaultdict(list)
    for key, start, ids, n, seq, at, placed in p.done:
        assert placed in ("whole", "level", "strung") and n == len(sent[key])
        got[key].append((start, ids.tolist()))
    assert {k: sum((ids for _, ids in sorted(v)), []) for k, v in got.items()} == {k: v.tolist() for k, v in sent.items()}


def links(texts):
    sets = {}
    for i, t in texts:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_pairs_across_components_follow_percent():
    import pyarrow as pa

    every = np.arange(7, dtype="<u8").tobytes()
    members = [{"label": i, "node": i, "size": 10, "rest": 3, "digest": i, "every": every, "prefix": every[:24]} for i in (1, 2)]
    found = lambda percent: [r for b in jaccard_join._across(percent)([pa.RecordBatch.from_pylist(members)]) for r in b.to_pylist() if r]
    assert found(50) == [{"a": 1, "b": 2}] and found(75) == []


@pytest.mark.parametrize("group", [jaccard_join.GROUP, 2])
def test_jaccard_join(docs, corpus, group):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs, group=group).collect()}
    assert got == links([(i, t) for i, t, _ in corpus])


def test_signatures_meet():
    """Similar sets share more signatures than the slack of either: over all sizes of a small range."""
    rng, useful = np.random.default_rng(1), 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[int(rng.integers(0, max(1, n // 3))) :], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64) * np.uint64(2)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        x, y = ({band: (set(s.tolist()), slack) for s, band, slack in jaccard_join.signatures(v, 75)} for v in (a, b))
        common = [k for k in x if k in y]
        assert common
        # in a band that both are in, no more are spoilt than the slack of either allows for
        assert all(len(x[k][0] & y[k][0]) > max(x[k][1], y[k][1]) for k in common)
        useful += any(x[k][1] >= 0 for k in common)
    assert useful > 1000


def test_toxicity_holds_out(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocab = [f"v{i}" for i in range(400)]
    texts, bad = [], []
    for _ in range(900):
        w = rng.choice(vocab, int(rng.integers(5, 60))).tolist()
        y = rng.random() < 0.3
        if y:
            w[int(rng.integers(len(w)))] = ["Vile", "nasty,", "foul"][int(rng.integers(3))]
        texts.append(" ".join(w))
        bad.append(int(y))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = spark.createDataFrame([(i, 1, b) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, y)
    assert len(model[0]) < 5000
    got = rows(toxicity.score(d, model))
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == bad[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    flipped = y.select("doc_id", "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    again = toxicity.fit(d, flipped)
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])
    clean = toxicity.keep_clean(d, model)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_ftrl_is_the_published_update():
    """One coordinate at a time, as published, against the vectorised learner; with and without L1."""
    rng = np.random.default_rng(4)
    data = [(np.r_[0, np.unique(rng.integers(1, 40, int(rng.integers(0, 12))))], float(rng.random() < 0.4)) for _ in range(400)]
    for l1, l2 in ((toxicity.L1, toxicity.L2), (0.0, 0.0), (0.3, 0.5)):
        model = toxicity.Ftrl(64, l1=l1, l2=l2)
        z, n = [0.0] * 64, [0.0] * 64

        def weight(i, l1=l1, l2=l2, z=z, n=n):
            own = 0.0 if i == 0 else l1
            if abs(z[i]) <= own:
                return 0.0
            return -(z[i] - math.copysign(own, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

        for f, y in data * 2:
            w = {i: weight(i) for i in f.tolist()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
            model.learn(f, y)
        assert model.weights(np.arange(64)).tolist() == pytest.approx([weight(i) for i in range(64)])


def test_toxicity_against_brute_force(spark):
    """The whole operator: features, order of learning, weights and scores, written out."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["good", "Day,", "vile", "x.y", "so"], int(rng.integers(0, 9)))) for _ in range(60)] + [None, "", "vile vile"]
    y = [int("vile" in (t or "")) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.score(d, toxicity.fit(d, labels)))

    def features(t):
        import pyarrow as pa

        w = re.split(r"[^0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        w = [x for x in w if x]
        hashed = {x: int(h) for _, _, c in toxicity.chunks(pa.array([" ".join(w)]), apart=toxicity.PUNCTUATION) for x, h in zip(w, c.hash.tolist(), strict=True)}
        one = lambda *v: int(toxicity.mix(np.array(v, np.uint64))[0])
        grams = [hashed[x] for x in w]
        for gap, salt in ((1, toxicity._SALTS[0]), (2, toxicity._SALTS[1])):
            grams += [one((hashed[a] * int(salt) + hashed[b]) % 2**64) for a, b in zip(w, w[gap:], strict=False)]
        return [0, *sorted({max(g >> 64 - toxicity.BITS, 1) for g in grams})]

    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    train.sort(key=lambda i: int(toxicity.mix(np.array([i], np.uint64))[0]))
    model = toxicity.Ftrl()
    for _ in range(toxicity.EPOCHS):
        for i in train:
            model.learn(np.array(features(texts[i])), float(y[i]))
    for i, t in enumerate(texts):
        p = 1 / (1 + math.exp(-model.weights(np.array(features(t))).sum()))
        assert got[i].score == pytest.approx(p, abs=1e-6) and got[i].predicted == (p >= 0.5)


def test_quality(docs, corpus):
    got = rows(quality.measure(docs))
    for i, t, _ in corpus:
        w, t = [x.decode() for x in words(t)], t or ""
        lines, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = set()
        for k in range(len(w) - 2):
            if c[w[k], w[k + 1], w[k + 2]] > 1:
                cover |= {k, k + 1, k + 2}
        r = got[i]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed)
        assert not (failed and r.kept)
        runs = set()
        for k in range(len(w) - 9):
            if sum(w[j : j + 10] == w[k : k + 10] for j in range(len(w) - 9)) > 1 if len(w) < 500 else True:
                runs |= set(range(k, k + 10))
        if len(w) < 500:
            assert r.covered_words == len(runs) and {x for s in r.spans for x in range(s.start, s.end)} == runs
            where, longest = list(range(len(w))), 0
            while where := [k for k in where if k + longest < len(w) and sum(w[j : j + longest + 1] == w[k : k + longest + 1] for j in range(len(w) - longest)) > 1]:
                longest += 1
            assert r.longest_repeat == longest
            bad = len(runs) > quality.MAX_COVERED * len(w) or longest >= quality.MIN_REPEAT and longest > quality.MAX_LONGEST * len(w)
            assert r.kept == (not failed and not bad)


def test_repeats_reject_what_the_base_rule_keeps(spark):
    some = lambda c, n: [f"{c}{k}" for k in range(n)]
    twice = lambda n, p: [*some("a", n // 2 - p), *some("p", p), *some("b", n - n // 2 - p), *some("p", p)]
    many = [w for k in range(12) for w in (*some(f"s{k % 4}x", 10), *some(f"t{k}x", 30))]
    texts = {"clean": some("a", 1000), "passage": twice(1000, 240), "longest": twice(1000, 90), "covered": many, "sentence": twice(300, 13)}
    got = rows(quality.measure(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id string, text string")))
    assert not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if r.kept} == {"clean", "sentence"}
    share = lambda k: (got[k].covered_words / got[k].n_words, got[k].longest_repeat / got[k].n_words)
    # each limit decides alone
    assert share("longest")[0] <= quality.MAX_COVERED and share("longest")[1] > quality.MAX_LONGEST
    assert share("covered")[0] > quality.MAX_COVERED and share("covered")[1] <= quality.MAX_LONGEST


def test_repeats_below_the_window(spark):
    got = rows(quality.measure(spark.createDataFrame([(1, "a b c a b d"), (2, "a b c"), (3, None)], "doc_id long, text string")))
    assert [got[i].longest_repeat for i in (1, 2, 3)] == [2, 0, 0] and got[1].n_repeat_words == 0


def test_longest_repeats():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = rng.integers(0, rng.integers(1, 4), rng.integers(0, 30)).astype(np.uint64)
        n = len(a)
        want = [max([next((k for k in range(n) if i + k >= n or j + k >= n or a[i + k] != a[j + k]), 0) for j in range(n) if j != i], default=0) for i in range(n)]
        assert quality.longest_repeats(a).tolist() == want


def least_capacity(sizes, shards):
    """By trying every sum of neighbours."""

    def need(cap):
        n, held = 1, 0
        for s in sizes:
            if held + s > cap:
                n, held = n + 1, 0
            held += s
        return n

    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    return next(c for c in sums if c >= max(sizes) and need(c) <= shards)


@pytest.mark.parametrize("ranges", [2, 8, sharding.RANGES])
def test_sharding(docs, corpus, monkeypatch, ranges):
    """Shards are the minimax partition of the groups themselves, however few ranges the driver sees at once."""
    monkeypatch.setattr(sharding, "RANGES", ranges)
    got = rows(sharding.shard(docs, shards=7))
    by, texts = defaultdict(list), defaultdict(set)
    for i, t, _ in corpus:
        r, raw = got[i], (t or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 7
        by[r.shard].append(r)
        texts[raw].add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    for parts in by.values():
        assert sorted(r.slot for r in parts) == list(range(len(parts)))
    groups = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("size")).groupBy("h").agg(F.sum("size").alias("size")).orderBy("h").collect()
    own = sharding.own_shards(sorted(((g.h, g.size) for g in groups), key=lambda g: -g[1]), sum(g.size for g in groups), 7)
    rest = [g for g in groups if g.h not in own]
    cap = least_capacity([g.size for g in rest], 7 - len(own))
    assert all(sum(r.size for r in by[s]) <= cap for s in range(len(own), 7))
    cuts = sharding.even_cuts([g.size for g in rest], 7 - len(own), cap)
    found, edges = sharding.partition(docs.sparkSession.createDataFrame(groups), 7)
    assert found == own and [sum(g.h < e for g in rest) for e in edges] == cuts


def test_capacity_is_least():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(0, 50, rng.integers(1, 14)).tolist()
        k = int(rng.integers(1, 6))

        def need(cap):
            shards, held = 1, 0
            for s in sizes:
                if held + s > cap:
                    shards, held = shards + 1, 0
                held += s
            return shards

        want = next(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= k)
        assert sharding.capacity(sizes, k) == want == least_capacity(sizes, k)
        cuts = sharding.even_cuts(sizes, k, want)
        assert len(cuts) + 1 <= k and cuts == sorted(set(cuts)) and 0 not in cuts
        assert max(sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)) <= want


def test_hot_group_gets_its_own_shard(spark):
    sizes = [(i << 40, 500 if i == 50 else 10) for i in range(100)]
    own, cuts = sharding.partition(spark.createDataFrame(sizes, "h long, size long"), 5)
    assert own == [50 << 40] and len(cuts) == 3
    edges = [0, *cuts, 100 << 40]
    load = [sum(v for c, v in sizes if a <= c < b and c not in own) for a, b in zip(edges, edges[1:], strict=False)]
    assert max(load) - min(load) <= 20


def test_exact_dedup(docs, corpus):
    got = rows(exact_dedup.mark(docs))
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, _ in corpus}
    by = defaultdict(list)
    for i, t in norm.items():
        by[t].append(i)
    for i, t in norm.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(by[t]), len(by[t]), i == min(by[t]), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(v) for v in by.values())


def test_substring_dedup(docs, corpus):
    got = rows(substring_dedup.dedup(docs))
    seen, gone = set(), defaultdict(set)
    for i, t, _ in corpus:
        w = words(t)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[i] |= set(range(k, k + 20))
            seen.add(x)
    assert any(gone.values())
    for i, t, _ in corpus:
        w = words(t)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone[i])
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (len(w), len(gone[i]), hashlib.sha256(kept).hexdigest(), kept.decode())
        assert {x for s in r.spans for x in range(s.start, s.end)} == gone[i]
