"""LM scoring with a weighted backoff automaton of smoothed n-grams.

States are the n-grams of up to ``order - 1`` words seen in training, beside a start
and the empty state. A word that followed a state in training has an arc, weighted
with its smoothed probability, to the longest state that the n-gram and the word end
in. For any other word a state has a failure arc, weighted with the mass kept back
there, to the state without its first word. A text is read once from left to right;
the state is carried on and log-probabilities add up.

Smoothing: P(w) is the discounted unigram, the mass kept back going to unknown
words; P(w | h) = (c(h w) + MU * P(w | h')) / (c(h) + MU), h' being h without its
first word, so a failure arc weighs MU / (c(h) + MU).

The automaton is never in one place. Each unit of rows (see ``units``) asks the
buckets for the counts of its own n-grams, over all training texts, and builds from
them the part of the automaton that its texts can reach. All its texts are then read
in step, long ones in segments: a segment's first state is found by reading the
``order - 1`` words before it, since no state is longer. Counts have 64 bits
throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.store import buckets, cuts, deal, packed, planes, reclaim, stash, unpacked, unplanes
from tarn.llm.text import chunks, mix
from tarn.llm.units import by_unit, distinct, grouped, merged, with_unit

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Longest n-grams of the registered model, in words.
ORDER = 2
#: Weight of the lower order in a state's arcs, in words.
MU = 50.0
#: Tokens of a segment; the segments of a unit are read in step.
SEGMENT = 512
_PAIR = np.uint64(0xA4093822299F31D1)


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and where each text begins."""
    parts, first, at = [], [np.zeros(1, np.int64)], 0
    for _, _, w in chunks(column):
        n = len(w)
        size = np.diff(w.first) + 1
        out = np.full(len(w.hash) + n, END, np.uint64)
        out[np.arange(len(w.hash)) + np.repeat(np.arange(n), size - 1)] = w.hash
        parts.append(out)
        first.append(at + np.cumsum(size))
        at += len(out)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(first)


def ngrams(t: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token, hashes of the n-grams of 1 to ``order`` words that end there; 0 where the text, its start counted as a word, is too short."""
    place = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
    out = [t]
    for k in range(2, order + 1):
        shorter = out[-1]
        before = np.r_[np.zeros(1, np.uint64), shorter[:-1]] if len(t) else t
        if k == 2:
            before = np.where(place == 0, START, before)
        out.append(np.where(place >= k - 2, mix(before * _PAIR + t), np.uint64(0)))
    return out


ASKED = "unit long, bucket int, level int, keys binary, counts binary"
ANSWERED = "unit long, bucket int, level int, counts binary, total long, kinds long, once long, twice long"


def _ask(n: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in by_unit(batches):
            t, first = tokens(rows.column(2))
            train = np.repeat(rows.column(1).to_numpy(), np.diff(first))
            out: list[list] = [[], [], [], [], []]
            for level, keys in enumerate(ngrams(t, first, order)):
                real = (keys != 0) | (level == 0)
                k, c = distinct(keys[train & real])
                other = distinct(keys[~train & real])[0]
                if len(other):
                    k, c = merged([(k, c), (other, np.zeros(len(other), np.int64))])
                for b, lo, hi in cuts(k, n):
                    for column, v in zip(out, (unit, b, level, packed(k[lo:hi]), planes(c[lo:hi])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["unit", "bucket", "level", "keys", "counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each level and bucket; answer each unit for its own keys, ascending."""
    held: dict[tuple[int, int], dict[int, list]] = {}
    for b in batches:
        for u, k, level, keys, counts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            held.setdefault((level, k), {}).setdefault(u, []).append((keys, counts))
    while held:
        (level, bucket), units = held.popitem()
        of = {u: [(unpacked(x), unplanes(c).astype(np.int64)) for x, c in parts] for u, parts in units.items()}
        key, count = merged([p for parts in of.values() for p in parts])
        facts = (int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum()))
        for u, parts in of.items():
            own = parts[0][0] if len(parts) == 1 else merged(parts)[0]
            got = planes(count[np.searchsorted(key, own)])
            yield pa.RecordBatch.from_arrays([pa.array([u], pa.int64()), pa.array([bucket], pa.int32()), pa.array([level], pa.int32()), pa.array([got], pa.binary()), *(pa.array([x], pa.int64()) for x in facts)], names=[f.split()[0] for f in ANSWERED.split(", ")])
            facts = (0, 0, 0, 0)  # once for each bucket


class Automaton:
    """The part of the backoff automaton that the texts of a unit can reach.

    State 0 is empty, 1 the start; then come the seen n-grams, shorter ones first.
    An arc is found by state and word. ``levels`` are the hashes of ``ngrams``,
    ``counts`` the training counts of their distinct values, ascending.
    """

    def __init__(self, levels: list[np.ndarray], first: np.ndarray, counts: list[np.ndarray], total: int, kinds: int, discount: float, mu: float):
        order = len(levels)
        unknown = min(max(discount * kinds, 1.0) / max(total, 1), 1.0)  # all unknown words as one
        self.unknown = np.log10(unknown)
        starts = np.zeros(len(levels[0]), bool)
        starts[first[:-1]] = True
        n_states, fail, fail_weight, keys, to, weight = 2, [], [], [], [], []
        for k, (hashes, c) in enumerate(zip(levels, counts, strict=True), 1):
            tokens_of = np.arange(len(hashes)) if k == 1 else np.flatnonzero(hashes)
            kind, one, place = np.unique(hashes[tokens_of], return_index=True, return_inverse=True)
            if len(kind) != len(c):
                raise RuntimeError("a unit's rows are not those that asked; its input changed between two reads")
            here = tokens_of[one]  # a token at which each n-gram ends
            if k == 1:
                self.words, self.count, self.n_words = place.astype(np.int32), c, len(kind)
                texts = c[place[first[1] - 1]]  # every training text starts once and ends once
                fail.append(np.zeros(2, np.int32))
                fail_weight.append(np.array([0.0, np.log10(mu / (texts + mu)) if order > 1 else 0.0]))
                p = np.where(c > 0, np.maximum(c - discount, 0) / max(total, 1), unknown)
                history = state = np.zeros(len(kind), np.int64)
            else:
                begins = starts[here] & (k == 2)
                before, suffix = gram[here - 1], gram[here]
                history = np.where(begins, 1, states[before])
                n_history = np.where(begins, texts, count[before])
                p = (c + mu * probability[suffix]) / (n_history + mu)
                state = states[suffix].copy()
            seen = c > 0
            keys.append(history[seen] * self.n_words + self.words[here[seen]])
            weight.append(np.log10(p[seen]))
            if k < order:  # the seen n-grams are states themselves
                fail.append(state[seen].astype(np.int32))
                fail_weight.append(np.log10(mu / (c[seen] + mu)))
                state = state.copy()
                state[seen] = n_states + np.arange(int(seen.sum()))
                n_states += int(seen.sum())
            to.append(state[seen])
            gram = np.zeros(len(hashes), np.int32)
            gram[tokens_of] = place
            states, probability, count = state, p, c
        del gram, place, tokens_of, here, p, history, state, states, probability, count
        key = np.concatenate(keys)
        by = np.argsort(key)
        # a last arc that no state and word have
        self.key, self.to = np.r_[key[by], np.iinfo(np.int64).max], np.r_[np.concatenate(to)[by], 0].astype(np.int32)
        self.weight = np.r_[np.concatenate(weight)[by], 0.0]
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a word each, and the log10 weights of the arcs taken, failure arcs among them."""
        state, total = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            want = state[todo].astype(np.int64) * self.n_words + word[todo]
            arc = np.searchsorted(self.key, want)
            hit = self.key[arc] == want
            total[todo[hit]] += self.weight[arc[hit]]
            state[todo[hit]] = self.to[arc[hit]]
            todo = todo[~hit]
            empty = state[todo] == 0
            total[todo[empty]] += self.unknown
            todo = todo[~empty]
            total[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return state, total

    def read(self, first: np.ndarray, order: int, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each text: its segments read from left to right, all of the unit in step."""
        size = np.diff(first)
        parts = -(-size // segment)
        text = np.repeat(np.arange(len(size)), parts)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * segment
        length = np.minimum(size[text] - begin, segment)
        by = np.argsort(-length, kind="stable")
        text, begin, length = text[by], begin[by], length[by]
        at = first[text] + begin
        state = (begin == 0).astype(np.int32)
        inner = np.flatnonzero(begin)
        for back in range(order - 1, 0, -1):  # into a segment's first state
            state[inner] = self.step(state[inner], self.words[at[inner] - back])[0]
        out = np.zeros(len(text))
        active = np.searchsorted(-length, -np.arange(segment), side="left")
        for i in range(segment):
            m = active[i]
            if not m:
                break
            state[:m], got = self.step(state[:m], self.words[at[:m] + i])
            out[:m] += got
        return np.bincount(text, out, len(size))


def score(df: DataFrame, train, key: str = "doc_id", text: str = "text", mu: float = MU, order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``train`` (a Column) says which rows the model learns from; null is no. Null
    and empty texts are one end token. Null keys are kept, repeated rows are rows
    of their own, extra columns not carried, whatever their names. Without any
    training row all words are unknown; an empty table gives no row. A text of any
    length is read whole, in segments.
    """
    spark = df.sparkSession
    n = buckets(df)
    rows = with_unit(df, [F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"), F.col(key).alias("key")], text)
    asked = rows.select("unit", "train", "text").mapInArrow(_ask(n, order), ASKED)
    answers = stash(deal(asked, n).mapInArrow(_answer, ANSWERED), "lm-counts")
    reclaim(spark)
    facts = answers.where("level = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "kinds", "once", "twice"))).collect()[0]
    total, kinds = facts["total"], facts["kinds"]
    discount = min(0.9, max(0.1, facts["once"] / max(facts["once"] + 2 * facts["twice"], 1)))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def counts(got: pa.Table, level: int) -> np.ndarray:
        """Counts of a unit's distinct n-grams: answers by ascending bucket are in the order of the ascending hashes."""
        mine = got.filter(pc.equal(got["level"], level)).sort_by("bucket")
        return np.concatenate([np.zeros(0, np.int64), *(unplanes(x).astype(np.int64) for x in mine["counts"].to_pylist())])

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        t, first = tokens(docs["text"])
        a = Automaton(ngrams(t, first, order), first, [counts(got, k) for k in range(order)], total, kinds, discount, mu)
        word = a.count[a.words]
        longs = lambda x: pa.array(np.asarray(x, np.int64))
        base = np.add.reduceat(np.log10(word + 1.0) - np.log10(float(total + kinds + 1)), first[:-1])
        known = np.add.reduceat((word > 0).astype(np.int64), first[:-1])
        return pa.table([docs["key"], pa.array(~docs["train"].to_numpy()), longs(np.diff(first)), longs(known), longs(np.full(docs.num_rows, total)), pa.array(base), pa.array(a.read(first, order))], names=schema.names)

    answers = answers.select("unit", "bucket", "level", "counts")
    # more tasks than buckets, so that each has few units
    return grouped(rows, 4 * n).cogroup(grouped(answers, 4 * n)).applyInArrow(lambda a, b: run(a, b), schema)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows with crc32(doc_id) mod 7 = 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
