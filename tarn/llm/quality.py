"""Quality rules: repetition found with a suffix array of each text's words.

The suffixes of all texts of a chunk are sorted together by prefix doubling, words
being told apart by their text, so that no common prefix reaches across texts; after
each step only suffixes that still tie are sorted again. Longest common prefixes of
neighbours come from the permuted array: where the words before a suffix and before
its neighbour agree, its prefix is one word shorter than that of the suffix before,
and only the others are compared. A position's longest repeat is the larger of its
two neighbours' prefixes; repeats of at least ``MIN_REPEAT`` words mark their spans,
whose union is the covered part. A text is rejected where that part, or its longest
repeat, is too large a share.

Memory is a fixed number of arrays as long as the chunk has words; a text beyond
``text.CHUNK`` bytes is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarn.llm.text import Words, chunks, grams

#: Words of a repeat that counts.
MIN_REPEAT = 10
#: Shares of a text's words: most that repeats may cover, and longest repeat. The base rule's 50 % bounds the covered
#: part, and two copies apart cover twice the longest repeat, so each limit is below half of the one before it.
MAX_COVERED, MAX_LONGEST = 0.2, 0.08
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_BLANK = b" \t\n\x0b\x0c\r"


#: Words that are compared for all suffixes at once; the few with longer common prefixes follow one by one.
_STEP = 32


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``ids`` in ascending order, a suffix before those it is a prefix of."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.r_[True, ids[order][1:] != ids[order][:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)  # where the group of suffixes with the same first k words begins
    rank[order] = head
    single = new & np.r_[new[1:], True]
    slots, k = np.flatnonzero(~single), 1
    while len(slots):
        at = order[slots]
        group, after = rank[at], np.full(len(at), -1, np.int64)
        more = at + k < n
        after[more] = rank[at[more] + k]
        by = np.lexsort((after, group))
        at, group, after = at[by], group[by], after[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        slots = slots[~(new & np.r_[new[1:], True])]
        k *= 2
    return order


def _agree(ids: np.ndarray, a: int, b: int) -> int:
    """Length of the longest common prefix of two suffixes, in blocks that grow."""
    n, size, at = len(ids), _STEP, 0
    while max(a, b) + at < n:
        end = min(size, n - max(a, b) - at)
        differ = np.flatnonzero(ids[a + at : a + at + end] != ids[b + at : b + at + end])
        if len(differ):
            return at + int(differ[0])
        at, size = at + end, size * 2
    return at


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run beginning there that also begins elsewhere (overlap allowed)."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order = suffix_order(ids)
    left = np.full(n, -1, np.int64)  # the neighbour before, in the order
    left[order[1:]] = order[:-1]
    here = np.arange(n)
    follows = (here > 0) & (left > 0)
    follows[follows] = ids[here[follows] - 1] == ids[left[follows] - 1]
    own = np.flatnonzero(~follows)
    found = np.zeros(len(own), np.int64)
    open_ = np.flatnonzero(left[own] >= 0)
    for _ in range(_STEP):
        a, b = own[open_] + found[open_], left[own[open_]] + found[open_]
        ok = (a < n) & (b < n)
        ok[ok] = ids[a[ok]] == ids[b[ok]]
        open_ = open_[ok]
        found[open_] += 1
        if not len(open_):
            break
    for i in open_.tolist():
        found[i] = _agree(ids, int(own[i]), int(left[own[i]]))
    last = np.searchsorted(own, here, side="right") - 1
    prefix = np.maximum(found[last] - (here - own[last]), 0)
    out = prefix.copy()
    some = left >= 0
    np.maximum.at(out, left[some], prefix[some])
    return out


def repeats(w: Words) -> np.ndarray:
    """``longest_repeats`` within each text of ``w``."""
    text = np.repeat(np.arange(len(w)), np.diff(w.first))
    order = np.lexsort((w.hash, text))
    h, t = w.hash[order], text[order]
    ids = np.empty(len(h), np.int64)
    ids[order] = np.cumsum(np.r_[False, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else 0
    return longest_repeats(ids)


def spans(repeat: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Union of ``[i, i + repeat[i])`` over repeats of at least ``least`` words."""
    at = np.flatnonzero(repeat >= least)
    if not len(at):
        return []
    reach = np.maximum.accumulate(at + repeat[at])
    cut = np.flatnonzero(np.r_[True, at[1:] > reach[:-1]])
    return list(zip(at[cut].tolist(), reach[np.r_[cut[1:] - 1, len(at) - 1]].tolist(), strict=True))


def _base(w: Words, i: int, h: np.ndarray) -> tuple[int, int, int, int]:
    lo, hi = w.offs[i], w.offs[i + 1]
    raw = w.raw[lo:hi]
    j, k = w.first[i], w.first[i + 1]
    chars = int((w.end[j:k] - w.start[j:k]).sum() - np.count_nonzero((raw & 0xC0) == 0x80))
    seen, dup = set(), 0
    for line in raw.tobytes().split(b"\n"):
        if line.strip(_BLANK):
            dup += line in seen
            seen.add(line)
    words = 0
    if len(h) >= 3:
        _, back, count = np.unique(grams(h, 3), return_inverse=True, return_counts=True)
        again = count[back] > 1
        cover = np.zeros(len(h), bool)
        for s in range(3):
            cover[s : s + len(again)] |= again
        words = int(cover.sum())
    return chars, int(np.count_nonzero(_SYMBOL[raw])), dup, words


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, spans array<struct<start:long,end:long>>, base_failed boolean, kept boolean"


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """Measures, repeated spans (word ranges) and verdict for every row: the key, then ``SCHEMA``.

    Null and empty texts have no words; with fewer than 50 words the base rule
    fails. Null keys are kept, repeated rows judged alike, extra columns not
    carried, whatever their names. A text of any length is sorted whole. An empty
    table gives no row.
    """
    kind = df.schema[key].simpleString().split(":", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]
            for _, _, w in chunks(b.column(1), lower=False):
                every = repeats(w)
                for i in range(len(w)):
                    h = w.of(i)
                    n = len(h)
                    base = _base(w, i, h)
                    r = every[w.first[i] : w.first[i + 1]]
                    longest = int(r.max()) if n else 0
                    found = spans(r, min_repeat) if longest >= min_repeat else []
                    covered = sum(e - s for s, e in found)
                    failed = n < 50 or 100 * base[3] > 50 * n
                    bad = covered > max_covered * n or longest >= min_repeat and longest > max_longest * n
                    for c, v in zip(cols, (n, *base, covered, longest, [{"start": s, "end": e} for s, e in found], failed, not (failed or bad)), strict=True):
                        c.append(v)
            types = [pa.int64()] * 7 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_(), pa.bool_()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *names])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    out = measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")
