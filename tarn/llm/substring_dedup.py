"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of the runs of ``SEED`` words inside each window of
``WINDOW`` words, the one with the least hash. A window's seed depends on its words
alone, so equal windows have equal seeds. Documents meet on their seeds: units of
rows (see ``units``) ask for which of their seeds the corpus has another
occurrence. Only there are matches extended, both ways: every window of full length
around a repeated seed is compared with those around the seed's other occurrences,
first within the unit and then, one for each unit, between units. Windows that
match at consecutive places are one longer match; ``spans`` are these, joined where
they touch, so that each is maximal: it covers what repeats of at least ``WINDOW``
words that start earlier cover, and no word can be added at either end. The first
occurrence of a repeat is left standing.

Windows between units are dealt by the hash of the whole window, so that neither a
hot seed nor a long passage is gathered: a task gets a window once from each unit
that has it.

Words are compared by 64-bit hashes of the window beside hashes of its seed: of 64 bits
within a unit, of 32 between units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.store import buckets, cuts, deal, packed, planes, reclaim, stash, unpacked, unplanes
from tarn.llm.text import chunks, grams, utf8
from tarn.llm.units import by_unit, distinct, grouped, merged, with_unit

WINDOW, SEED = 20, 10
_NO_KEY = np.iinfo(np.int64).max


def least(g: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive entries."""
    have, m = 1, g
    while 2 * have <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = span - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Windows:
    """All windows of a unit: row, first word, seed and extended hash; and the distinct seeds with their occurrences."""

    def __init__(self, column, window: int, seed: int):
        rows, pos, seeds, full, seen = [], [], [], [], []
        self.n_words = np.zeros(len(column), np.int64)
        span = window - seed + 1
        for lo, hi, w in chunks(column, lower=False):
            size = np.diff(w.first)
            self.n_words[lo:hi] = size
            if len(w.hash) < window:
                continue
            doc = np.repeat(np.arange(hi - lo), size)
            p = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
            if not len(p):
                continue
            g = grams(w.hash, seed)
            a = least(g, span)[p]
            at = np.zeros(len(g), bool)
            for s in range(span):
                hit = p + s
                at[hit[g[hit] == a]] = True
            rows.append((doc[p] + lo).astype(np.int32))
            pos.append((p - w.first[doc[p]]).astype(np.int32))
            seeds.append(a)
            full.append(grams(w.hash, window)[p])
            seen.append(g[at])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.row, self.pos, self.seed, self.full = cat(rows, np.int32), cat(pos, np.int32), cat(seeds, np.uint64), cat(full, np.uint64)
        self.keys, self.count = distinct(cat(seen, np.uint64))


def _ask(n: int, window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in by_unit(batches):
            w = Windows(rows.column(1), window, seed)
            got = [(unit, b, packed(w.keys[lo:hi]), np.minimum(w.count[lo:hi], 2).astype(np.uint8).tobytes()) for b, lo, hi in cuts(w.keys, n)]
            if got:
                u, b, k, c = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["unit", "bucket", "keys", "counts"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each unit's seeds, in their order, a bit: whether the corpus has it at two places."""
    held: dict[int, dict[int, list]] = {}
    for b in batches:
        for u, k, keys, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            held.setdefault(k, {}).setdefault(u, []).append((unpacked(keys), np.frombuffer(counts, np.uint8)))
    for k, units in held.items():
        key, count = merged([p for parts in units.values() for p in parts])
        for u, parts in units.items():
            own = parts[0][0] if len(parts) == 1 else merged(parts)[0]
            bits = np.packbits(count[np.searchsorted(key, own)] > 1).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([u], pa.int64()), pa.array([k], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([bits], pa.binary())], names=["unit", "bucket", "n", "bits"])


ANSWER = "unit long, bucket int, n long, bits binary"
PARTS = ("full", "seeds", "docs", "rows", "pos")
FOUND = "unit long, row long, key long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept_text string, pending string, removed binary, bucket int, " + ", ".join(f"{p} binary" for p in PARTS)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = [("unit", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("pending", pa.string()), ("removed", pa.binary()), ("bucket", pa.int32()), *((p, pa.binary()) for p in PARTS)]


def _table(rows: list[dict], fields: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


def finish(raw: bytes, starts: np.ndarray, window: int, texts: bool) -> dict:
    """Result of one text whose windows at ``starts`` are removed. ``bytes.split`` splits at exactly the white space meant here."""
    words = raw.split()
    n = len(words)
    out: dict = {"n_words": n, "n_removed": 0, "spans": []}
    if len(starts):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        out["spans"] = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
        out["n_removed"] = int(gone.sum())
        words = [w for w, g in zip(words, gone, strict=True) if not g]
    kept = b" ".join(words)
    out["kept_sha256"] = hashlib.sha256(kept).hexdigest()
    if texts:
        out["kept_text"] = kept.decode("utf-8", "replace")
    return out


def _extend(n: int, window: int, seed: int, texts: bool):
    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        w = Windows(docs["text"], window, seed)
        got = got.sort_by("bucket")
        bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:m] for m, b in zip(got["n"].to_pylist(), got["bits"].to_pylist(), strict=True)]
        again = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        if len(again) != len(w.keys):
            raise RuntimeError("a unit's rows are not those that asked; its input changed between two reads")
        keys = [_NO_KEY if k is None else k for k in docs["key"].to_pylist()]
        texts_of = docs["text"]
        rank = np.empty(len(keys), np.int64)
        rank[sorted(range(len(keys)), key=lambda i: (keys[i], i))] = np.arange(len(keys))
        use = np.flatnonzero(again[np.searchsorted(w.keys, w.seed)]) if len(w.seed) else np.zeros(0, np.int64)
        row, pos, a, f = w.row[use], w.pos[use], w.seed[use], w.full[use]
        order = np.lexsort((pos, rank[row], f, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (f[order][1:] != f[order][:-1])] if len(order) else np.zeros(0, bool)
        first = np.zeros(len(use), bool)
        first[order[new]] = True
        out: list[dict] = []
        if first.any():
            r, p, s, x = row[first], pos[first], a[first], f[first]
            o = np.argsort(x, kind="stable")
            r, p, s, x = r[o], p[o], s[o], x[o]
            ids = np.array(keys, np.int64)
            for b, lo, hi in cuts(x, n):
                out.append({"unit": 0, "bucket": b, "full": packed(x[lo:hi]), "seeds": s[lo:hi].astype("<u4").tobytes(), "docs": planes(ids[r[lo:hi]]), "rows": planes(r[lo:hi]), "pos": planes(p[lo:hi])})
        waits = np.zeros(len(keys), bool)
        waits[row[first]] = True
        gone_row, gone_pos = row[~first], pos[~first]
        by = np.argsort(gone_row, kind="stable")
        at = np.searchsorted(gone_row[by], np.arange(len(keys) + 1))
        buf, offs = utf8(texts_of)
        for i, k in enumerate(docs["key"].to_pylist()):
            starts = gone_pos[by[at[i] : at[i + 1]]]
            raw = buf[offs[i] : offs[i + 1]].tobytes()
            base = {"row": i, "key": k}
            if waits[i]:
                out.append(base | {"pending": raw.decode("utf-8", "replace"), "removed": starts.astype("<u4").tobytes()})
            else:
                out.append(base | finish(raw, starts, window, texts))
        unit = docs["unit"][0].as_py()
        for x in out:
            x["unit"] = unit
        return _table(out, _ARROW)

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal windows, all but the one with the smallest (document, start) are marked for removal."""
    by: dict[int, list] = {}
    for b in batches:
        for x in zip(*(b.column(i).to_pylist() for i in range(2 + len(PARTS))), strict=True):
            by.setdefault(x[1], []).append(x)
    while by:
        _, parts = by.popitem()
        parts.sort(key=lambda x: x[0])
        full = [unpacked(x[2]) for x in parts]
        ends = np.cumsum([0, *map(len, full)])
        full = np.concatenate(full)
        seed = np.concatenate([np.frombuffer(x[3], "<u4") for x in parts])
        doc, pos = (np.concatenate([unplanes(x[i]).astype(np.int64) for x in parts]) for i in (4, 6))
        order = np.lexsort((pos, doc, seed, full))
        later = np.zeros(len(full), bool)
        later[order[1:]] = (seed[order][1:] == seed[order][:-1]) & (full[order][1:] == full[order][:-1])
        for x, lo, hi in zip(parts, ends, ends[1:], strict=False):
            gone = later[lo:hi]
            if gone.any():
                rows = unplanes(x[5])[gone].astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([rows.tobytes()], pa.binary()), pa.array([pos[lo:hi][gone].astype("<u4").tobytes()], pa.binary())], names=["unit", "rows", "starts"])


def _close(window: int, texts: bool):
    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        cat = lambda c: np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") for x in got[c].to_pylist())])
        rows, starts = cat("rows"), cat("starts")
        by = np.argsort(rows, kind="stable")
        rows, starts = rows[by], starts[by]
        out = []
        for r in docs.to_pylist():
            lo, hi = np.searchsorted(rows, [r["row"], r["row"] + 1])
            gone = np.r_[starts[lo:hi], np.frombuffer(r["removed"], "<u4")].astype(np.int64)
            out.append({"key": r["key"]} | finish(r["pending"].encode(), gone, window, texts))
        return _table(out, [f for f in _ARROW if f[0] in _RESULT])

    return run


_RESULT = ("key", "n_words", "n_removed", "spans", "kept_sha256", "kept_text")
RESULT = "key long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept_text string"


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, texts: bool = True) -> DataFrame:
    """(key, n_words, n_removed, spans, kept_sha256, kept_text) for every row; ``kept_text`` is null without ``texts``.

    ``spans`` are the removed word ranges. Keys are integers; rows with a null key
    come after all others. Null texts and texts shorter than a window lose
    nothing; a text of any length is read whole. Of rows that repeat a key and
    words, one keeps them. Extra columns are not carried, whatever their names; an
    empty table gives no row.
    """
    n = buckets(df)
    rows = with_unit(df, [F.col(text).alias("text"), F.col(key).cast("long").alias("key")], text)
    asked = deal(rows.select("unit", "text").mapInArrow(_ask(n, window, seed), "unit long, bucket int, keys binary, counts binary"), n).mapInArrow(_repeated, ANSWER)
    extend, close = _extend(n, window, seed, texts), _close(window, texts)
    found = grouped(rows, n).cogroup(grouped(asked, n)).applyInArrow(lambda a, b: extend(a, b), FOUND)
    found = stash(found, "substrings")
    reclaim(df.sparkSession)
    blobs = found.where("bucket is not null").select("unit", "bucket", *PARTS)
    later = deal(blobs, n).mapInArrow(_first, "unit long, rows binary, starts binary")
    waiting = found.where("pending is not null").select("unit", "row", "key", "pending", "removed")
    closed = grouped(waiting, n).cogroup(grouped(later, n)).applyInArrow(lambda a, b: close(a, b), RESULT)
    out = found.where("kept_sha256 is not null").select(*_RESULT).unionByName(closed)
    return out.withColumnRenamed("key", key)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS p FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM p JOIN d USING (doc_id)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS i FROM r WHERE n > 1),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
      FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM m
"""
