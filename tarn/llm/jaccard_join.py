"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its hashed ``SHINGLE``-word shingles; documents with equal
sets are one node. Sets of sizes s and t with a Jaccard similarity of at least
``PERCENT`` % differ in at most k = (s + t) (100 - PERCENT) / (100 + PERCENT)
elements. Sizes are banded; in each band the domain of shingles is divided into
partitions, each of these into ``SUBPARTS`` parts, and a set has one signature for
each choice of all but one of a partition's parts: its elements there. An element in
which two sets differ spoils two of the three signatures of its partition and a
second one in the same partition the third, so k of them spoil at most
min(2 k, k + partitions). A set with more signatures shares at least one with every
similar set of the band; choices without an element are no signatures. In the bands
of small sets a partition is a single shingle, not divided, and k elements spoil k.

Groups of a signature with up to ``GROUP`` nodes give all their pairs. Larger ones
give none, and are made up for exactly:

1. A node still found without them (enough signatures in small groups) needs
   nothing. A pair is at stake only if both of its nodes are not.
2. Those nodes enumerate partitions of single shingles. Pairs that share a shingle
   of at most ``GROUP`` of them are found. What remains shares frequent shingles
   only, so both sets consist of them to ``PERCENT`` % at least.
3. Of nodes with equal frequent parts, all that can be linked are linked to the one
   with the fewest other shingles. The rest meet by prefixes of their frequent parts:
   first each with the group's leader; then those of a group that are still in
   different components, pair by pair.

Pairs must share as many signatures as their sizes demand; those left are verified
on whole sets, the last step's after the components of all others are known. No
link between components is lost.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.components import components
from tarn.llm.store import buckets, cuts, deal, discard, packed, reclaim, stash, unpacked
from tarn.llm.text import chunks, grams, mix

SHINGLE, PERCENT = 5, 75
#: Nodes of a signature's group whose pairs are all enumerated.
GROUP = 12
#: Bands grow by this factor; partitions for each element of a band's smallest set.
RATIO, PARTITIONS = 1.5, 0.3
#: Parts of a partition; signatures are over all but one of them. The bound on spoilt signatures above is for three.
SUBPARTS = 3
#: Sets below this size have one partition for each shingle.
SINGLE = 30
_FREE = 1 << 40
_BAND, _PART, _SHORT, _LEFT = np.uint64(0x082EFA98EC4E6C89), np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C), np.uint64(0xC0AC29B7C97C50DD)


def bounds(upto: int = 1 << 40) -> list[int]:
    """Smallest sizes of the bands."""
    out = [1]
    while out[-1] < upto:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


BOUNDS = bounds()


def most(size: int, percent: int) -> int:
    """Largest size of a set that can be similar to one of ``size``."""
    return 100 * size // percent


def differ(s: int, t: int, percent: int) -> int:
    """Most elements in which similar sets of these sizes differ."""
    return (s + t) * (100 - percent) // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, partitions, k) for each band that a set of ``size`` is in: as one of the smaller sets, or as the larger of a pair. 0 partitions stand for one of each shingle."""
    own = bisect_right(BOUNDS, size) - 1
    out = []
    for b in (own, own - 1, own - 2, own - 3):
        if b < 0:
            break
        top = most(BOUNDS[b + 1] - 1, percent)
        if size > top:
            break
        parts = 0 if BOUNDS[b] < SINGLE else int(np.ceil(PARTITIONS * BOUNDS[b]))
        out.append((b, parts, differ(size, min(top, most(size, percent)), percent)))
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Ascending distinct shingle hashes of a text's word hashes; a shorter text is one shingle."""
    if not len(h):
        return h
    if len(h) < k:
        return grams(h, len(h)) ^ _SHORT
    return np.unique(grams(h, k))


def node_of(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s ^ _PART).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def signatures(s: np.ndarray, percent: int) -> list[tuple[np.ndarray, int, int]]:
    """(signatures, band, slack) for each band; slack: how many may be lost with the rest still more than k elements can spoil."""
    out = []
    value = mix(s + _BAND)
    for band, parts, k in bands(len(s), percent):
        salt = np.uint64(band) * _BAND
        if not parts:
            sig = mix(value ^ salt)
            spoilt = k
        else:
            part = (((s >> np.uint64(32)) * np.uint64(parts * SUBPARTS)) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            held, some = np.zeros(parts * SUBPARTS, np.uint64), np.zeros(parts * SUBPARTS, bool)
            held[part[at]], some[part[at]] = np.add.reduceat(value, at), True
            held, some = held.reshape(parts, SUBPARTS), some.reshape(parts, SUBPARTS)
            all_of, n = held.sum(axis=1, dtype=np.uint64)[:, None], some.sum(axis=1)
            choice = np.arange(parts, dtype=np.uint64)[:, None] * _PART + np.arange(SUBPARTS, dtype=np.uint64)[None] * _LEFT + salt
            sig = mix((all_of - held) ^ mix(choice))[n[:, None] > some]  # all but one, where an element is left
            spoilt = min(2 * k, k + int(np.count_nonzero(n)))
        # the lowest bits tell the bands of one set apart: they follow each other
        out.append(((sig & ~np.uint64(3)) | np.uint64(band & 3), band, len(sig) - spoilt - 1))
    return out


#: What tasks exchange. docs, nodes and sizes: rows of the input; node, rep, size and slacks: nodes; sig and sig_node: signatures.
SENT = "bucket int, docs binary, nulls binary, doc_nodes binary, doc_sizes binary, node binary, rep binary, size binary, slack binary, sig binary, sig_node binary"
_SENT = [x.split()[0] for x in SENT.split(", ")]
#: kind 0: document a of node b and size c. 1: node a with document b, size c and slack d in band e. 2: nodes a and b share c signatures in band e. 3: node a has c signatures in large groups in band e.
GOT = "kind int, a long, b long, c long, d long, e long"
_NONE = np.iinfo(np.int64).max


def _batch(cols: dict[str, list]) -> pa.RecordBatch:
    n = len(cols["bucket"])
    return pa.RecordBatch.from_arrays([pa.array(cols["bucket"], pa.int32()), *(pa.array(cols.get(c) or [None] * n, pa.binary()) for c in _SENT[1:])], names=_SENT)


def _send(n: int, shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sig: list[np.ndarray] = []
        own: list[np.ndarray] = []
        turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if sig:
                s, o = np.concatenate(sig), np.concatenate(own)
                order = np.argsort(s)
                s, o = s[order], o[order]
                at = cuts(s, n)
                yield _batch({"bucket": [b for b, _, _ in at], "sig": [packed(s[x:y]) for _, x, y in at], "sig_node": [o[x:y].tobytes() for _, x, y in at]})
                sig.clear()
                own.clear()

        for b in batches:
            keys = b.column(0)
            null = np.asarray(keys.is_null())
            key = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            nodes, sizes = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            fresh: dict[tuple[int, int], list] = {}
            held = 0
            for lo, _, w in chunks(b.column(1)):
                for i in range(len(w)):
                    s = shingles(w.of(i), shingle)
                    if not len(s):
                        continue
                    x, j = node_of(s), lo + i
                    nodes[j], sizes[j] = x, len(s)
                    doc = _NONE if null[j] else int(key[j])
                    new = x not in seen
                    seen.add(x)
                    for g, band, slack in signatures(s, percent):
                        f = fresh.setdefault((x, band), [doc, len(s), slack])
                        f[0] = min(f[0], doc)
                        if new:
                            sig.append(g)
                            own.append(np.full(len(g), x, np.int64))
                            held += len(g)
                    if held > 1 << 20:
                        yield from flush()
                        held = 0
            if len(key):
                # the rows themselves go to any bucket in turn: one node's rows are not gathered
                turn = (turn + int(mix(key[:1].view(np.uint64))[0] % np.uint64(n))) % n
                yield _batch({"bucket": [turn], "docs": [key.tobytes()], "nulls": [null.tobytes()], "doc_nodes": [nodes.tobytes()], "doc_sizes": [sizes.tobytes()]})
            if fresh:
                k = np.array([x for x, _ in fresh], np.int64)
                v = np.array([[band, *f] for (_, band), f in fresh.items()], np.int64)
                order = np.argsort(k.view(np.uint64), kind="stable")
                k, v = k[order], v[order]
                at = cuts(k.view(np.uint64), n)
                yield _batch({"bucket": [c for c, _, _ in at], "node": [k[x:y].tobytes() for _, x, y in at], "rep": [np.ascontiguousarray(v[x:y, 1]).tobytes() for _, x, y in at], "size": [np.ascontiguousarray(v[x:y, 2]).tobytes() for _, x, y in at], "slack": [np.ascontiguousarray(v[x:y, [0, 3]]).tobytes() for _, x, y in at]})
            if held:
                yield from flush()

    return run


def grouped(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, nodes, size of the entry's group), sorted, without repeats and groups of one."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])] if len(sig) else np.zeros(0, bool)
    sig, node = sig[keep], node[keep]
    at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(sig)])
    each = np.repeat(size, size)
    return sig[each > 1], node[each > 1], each[each > 1]


def small_pairs(node: np.ndarray, mark: np.ndarray, each: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, mark, times) over all pairs a < b of groups of at most ``group``."""
    a, b, m = [], [], []
    for size in range(2, group + 1):
        own = node[each == size].reshape(-1, size)
        mk = mark[each == size].reshape(-1, size)[:, 0]
        for i in range(size):
            for j in range(i + 1, size):
                a.append(own[:, i])
                b.append(own[:, j])
                m.append(mk)
    a, b, m = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, m))
    order = np.lexsort((m, b, a))
    a, b, m = a[order], b[order], m[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (m[1:] != m[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], m[at], np.diff(np.r_[at, len(a)])


def _rows(kind: int, a, b=None, c=None, d=None, e=None) -> pa.RecordBatch:
    n = len(a)
    col = lambda x: pa.nulls(n, pa.int64()) if x is None else x if isinstance(x, pa.Array) else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), col(a), col(b), col(c), col(d), col(e)], names=["kind", "a", "b", "c", "d", "e"])


def _meet(group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[tuple[int, int], list[int]] = {}
        sig: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["docs"] is not None:
                    key, null = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["nulls"], bool)
                    yield _rows(0, pa.array(key, mask=null), np.frombuffer(r["doc_nodes"], np.int64), np.frombuffer(r["doc_sizes"], np.int64))
                if r["node"] is not None:
                    s = np.frombuffer(r["slack"], np.int64).reshape(-1, 2)
                    for x, rep, size, (band, slack) in zip(*(np.frombuffer(r[c], np.int64).tolist() for c in ("node", "rep", "size")), s.tolist(), strict=True):
                        f = nodes.setdefault((x, band), [rep, size, slack])
                        f[0] = min(f[0], rep)
                if r["sig"] is not None:
                    sig.setdefault(r["bucket"], []).append((r["sig"], r["sig_node"]))
        if nodes:
            v = np.array([[x, *f, band] for (x, band), f in nodes.items()], np.int64)
            yield _rows(1, v[:, 0], pa.array(v[:, 1], mask=v[:, 1] == _NONE), v[:, 2], v[:, 3], v[:, 4] & 3)
        while sig:
            _, parts = sig.popitem()
            s, x, each = grouped(np.concatenate([unpacked(p[0]) for p in parts]), np.concatenate([np.frombuffer(p[1], np.int64) for p in parts]))
            mark = (s & np.uint64(3)).astype(np.int64)
            a, b, m, times = small_pairs(x, mark, each, group)
            if len(a):
                yield _rows(2, a, b, times, None, m)
            large = each > group
            if large.any():
                x, m = x[large], mark[large]
                order = np.lexsort((m, x))
                x, m = x[order], m[order]
                at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (m[1:] != m[:-1])])
                yield _rows(3, x[at], None, np.diff(np.r_[at, len(x)]), None, m[at])

    return run


SETS = "node long, size long, shingles binary"


def _sets(shingle: int):
    """The set of each text's shingles, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, w in chunks(b.column(0)):
                got = {node_of(s): s for s in (shingles(w.of(i), shingle) for i in range(len(w))) if len(s)}
                got = {x: s for x, s in got.items() if x not in seen}
                seen.update(got)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([len(s) for s in got.values()], pa.int64()), pa.array([s.tobytes() for s in got.values()], pa.binary())], names=["node", "size", "shingles"])

    return run


def _singles(n: int, column: int = 2):
    """Every element of the sets in column ``column``, dealt to buckets, with the node (column 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            s = np.concatenate([x[1] for x in held])
            o = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
            order = np.argsort(s)
            s, o = s[order], o[order]
            at = cuts(s, n)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in at], pa.int32()), pa.array([s[x:y].tobytes() for _, x, y in at], pa.binary()), pa.array([o[x:y].tobytes() for _, x, y in at], pa.binary())], names=["bucket", "sig", "sig_node"])
            held.clear()

        for b in batches:
            for x, s in zip(b.column(0).to_pylist(), b.column(column).to_pylist(), strict=True):
                held.append((x, np.frombuffer(s, "<u8")))
                size += len(held[-1][1])
                if size > 1 << 20:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


#: kind 2 as above. 4: frequent shingles with their nodes, of the nodes in bucket a.
MET = "kind int, a long, b long, c long, nodes binary, shingles binary"


def _meet_singles(group: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for k, s, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(k, []).append((np.frombuffer(s, "<u8"), np.frombuffer(x, np.int64)))
        names = ["kind", "a", "b", "c", "nodes", "shingles"]
        none = lambda k, t: pa.nulls(k, t)
        for parts in held.values():
            s, x, each = grouped(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            a, b, _, times = small_pairs(x, np.zeros(len(x), np.int64), each, group)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), 2, np.int32)), pa.array(a), pa.array(b), pa.array(times.astype(np.int64)), none(len(a), pa.binary()), none(len(a), pa.binary())], names=names)
            large = each > group
            if large.any():
                x, s = x[large].view(np.uint64), s[large]
                order = np.argsort(x, kind="stable")
                x, s = x[order], s[order]
                at = cuts(x, n)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 4, np.int32)), pa.array([c for c, _, _ in at], pa.int64()), none(k, pa.int64()), none(k, pa.int64()), pa.array([x[i:j].tobytes() for _, i, j in at], pa.binary()), pa.array([s[i:j].tobytes() for _, i, j in at], pa.binary())], names=names)

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, lost, shingles): the frequent shingles of each node, ascending."""
    nodes, shingle = [], []
    for b in batches:
        nodes += [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        shingle += [np.frombuffer(x, "<u8") for x in b.column(2).to_pylist()]
    if not nodes:
        return
    x, s = np.concatenate(nodes), np.concatenate(shingle)
    order = np.lexsort((s, x))
    x, s = x[order], s[order]
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends = np.r_[at[1:], len(x)]
    yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array((ends - at).astype(np.int64)), pa.array([s[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary())], names=["a", "lost", "shingles"])


FREQUENT = "node long, size long, rest long, digest long, prefix binary"


def _frequent(percent: int):
    """Nodes whose frequent part can link them to another, with its digest and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, size, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = np.frombuffer(own, "<u8")
                need = -(-percent * size // 100)
                if len(f) >= need:
                    out.append((x, size, size - len(f), node_of(f), f[: len(f) - need + 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["node", "size", "rest", "digest", "prefix"])

    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, c): leader and member of each group of a prefix's element, and how often they meet. The node with the fewest other shingles leads."""
    elements, nodes, rests, size = [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            elements.append(np.frombuffer(r["prefix"], "<u8"))
            nodes.append(r["node"])
            rests.append(r["rest"])
            size.append(len(elements[-1]))
    if not elements:
        return
    s, x, rest = np.concatenate(elements), np.repeat(np.array(nodes, np.int64), size), np.repeat(np.array(rests, np.int64), size)
    order = np.lexsort((x, rest, s))
    s, x = s[order], x[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    lead = np.repeat(x[at], np.diff(np.r_[at, len(s)]))
    a, b = lead[lead != x], x[lead != x]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(np.diff(np.r_[at, len(a)]).astype(np.int64))], names=["a", "b", "c"])


def _across(percent: int):
    """(a, b): pairs that share a prefix's element, with different labels and frequent parts and sizes that allow a link; each at its least common element only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                every = np.frombuffer(r["every"], "<u8")
                for k in np.frombuffer(r["prefix"], "<u8").tolist():
                    held.setdefault(k, []).append((r["label"], r["node"], r["size"], r["rest"], r["digest"], every))
        for k, members in held.items():
            if len({m[0] for m in members}) < 2:
                continue
            m = np.array([x[:5] for x in members], np.int64)
            before = [x[5][x[5] < np.uint64(k)] for x in members]  # what they might have met at already
            of = np.repeat(np.arange(len(members)), [len(x) for x in before])
            element, column = np.unique(np.concatenate(before), return_inverse=True)
            by = np.argsort(column, kind="stable")
            of, ends = of[by], np.searchsorted(column[by], np.arange(len(element) + 1))  # members of each element
            own_elements = np.split(column, np.cumsum([len(x) for x in before])[:-1])
            for i in range(len(m) - 1):
                o, own = m[i + 1 :], m[i]
                both = np.minimum(own[2] - own[3], o[:, 2] - o[:, 3])
                ok = (o[:, 0] != own[0]) & (o[:, 4] != own[4]) & ((100 + percent) * both >= percent * (own[2] + o[:, 2]))
                if ok.any():
                    for e in own_elements[i].tolist():
                        met = of[ends[e] : ends[e + 1]]
                        ok[met[met > i] - i - 1] = False
                    other = o[ok, 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[1], other)), pa.array(np.maximum(own[1], other))], names=["a", "b"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for a, b, s, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s, t = np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among pairs (a, b), by whole sets."""
    s = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    t = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    return pairs.select("a", "b").join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(_similar(percent), "u long, v long")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """(key, n_shingles, component_id) for every row.

    A-Z is lower-cased. A row without words has no shingle, links with nothing and
    is its own component. Null keys never name a component unless all of it is
    null. Repeated rows are nodes of one set. Keys are integers. Texts of any length
    are read whole. Extra columns are not carried, whatever their names; an empty
    table gives no row. Sets are compared by 64-bit hashes of their shingles, and
    are equal where 64-bit hashes of the sets are.
    """
    spark = df.sparkSession
    n = buckets(df)
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    met = stash(deal(docs.mapInArrow(_send(n, shingle, percent), SENT), n).mapInArrow(_meet(group), GOT), "signatures")
    reclaim(spark)
    lost = met.where("kind = 3").groupBy("a", "e").agg(F.sum("c").alias("lost")).select(F.col("a").alias("la"), F.col("e").alias("le"), "lost")
    info = met.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("rep"), F.col("c").alias("size"), F.col("d").alias("slack"), F.col("e").alias("band"))
    info = info.join(lost, (F.col("node") == F.col("la")) & (F.col("band") == F.col("le")), "left").select("node", "rep", "size", "band", (F.col("slack") - F.coalesce("lost", F.lit(0))).alias("slack"))
    info = stash(info, "nodes")
    open_nodes = info.where("slack < 0").select("node").distinct()

    pairs = met.where("kind = 2").groupBy("a", "b", "e").agg(F.sum("c").alias("c"))
    # of two nodes that are both open, the next step finds out
    pairs = _plausible(pairs, info, percent, F.greatest("sa", "sb") >= 0)
    pairs = stash(pairs, "pairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(open_nodes).distinct()
    need = info.join(need, "node", "left_semi").select("node", F.col("rep").alias("key")).distinct()
    texts = docs.join(need.where("key is not null").select("key").distinct(), "key", "left_semi").select("text")
    # nodes whose rows all have no id are found among these
    unnamed = docs.where("key is null").select("text").mapInArrow(_sets(shingle), SETS).join(need.where("key is null").select("node"), "node", "left_semi")
    sets = stash(texts.mapInArrow(_sets(shingle), SETS).unionByName(unnamed), "sets")
    sets = sets.dropDuplicates(["node"]) if _repeats(sets) else sets

    singles = sets.join(open_nodes, "node", "left_semi").mapInArrow(_singles(n), "bucket int, sig binary, sig_node binary")
    single = stash(deal(singles, n).mapInArrow(_meet_singles(group, n), MET), "singles")
    often = deal(single.where("kind = 4").select(F.col("a").cast("int").alias("bucket"), "nodes", "shingles"), n).mapInArrow(_assemble, "a long, lost long, shingles binary")
    often = stash(often, "often")
    plain = info.groupBy("node").agg(F.first("size").alias("size"))
    # a set is a partition of single shingles: size - 1 - k may be lost
    limit = F.col("size") - 1 - F.floor((F.col("size") + F.floor(F.col("size") * 100 / percent)) * (100 - percent) / (100 + percent)).cast("long")
    info1 = plain.join(open_nodes, "node", "left_semi").join(often.select(F.col("a").alias("la"), "lost"), F.col("node") == F.col("la"), "left").select("node", "size", (limit - F.coalesce("lost", F.lit(0))).alias("slack"), F.lit(0).cast("long").alias("band"))
    info1 = stash(info1, "nodes")
    pairs1 = single.where("kind = 2").groupBy("a", "b").agg(F.sum("c").alias("c")).withColumn("e", F.lit(0).cast("long"))
    pairs1 = _plausible(pairs1, info1, percent)

    frequent = often.join(info1.select("node", "size"), F.col("a") == F.col("node")).select("node", "size", "shingles").mapInArrow(_frequent(percent), FREQUENT)
    frequent = alike = stash(frequent, "frequent")
    lead = frequent.groupBy("digest").agg(F.min(F.struct("rest", "node")).alias("lead")).select(F.col("digest").alias("d"), "lead")
    frequent = frequent.join(lead, F.col("digest") == F.col("d")).withColumn("led", (F.col("node") != F.col("lead.node")) & ((100 - percent) * (F.col("size") - F.col("rest")) >= percent * (F.col("rest") + F.col("lead.rest"))))
    frequent = stash(frequent.select("node", "size", "rest", "digest", "prefix", F.when(F.col("led"), F.col("lead.node")).alias("lead")), "frequent")
    equal = frequent.where("lead is not null").select(F.col("lead").alias("a"), F.col("node").alias("b"), (F.col("size") - F.col("rest")).alias("c"))
    rest = frequent.where("lead is null")
    stars = _by_element(rest.withColumn("label", F.lit(0).cast("long")), n).mapInArrow(_leaders, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    columns = ["a", "b", "c"]
    every = pairs.select(columns).unionByName(pairs1.select(columns)).unionByName(equal).unionByName(stars)
    every = stash(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c").groupBy("a", "b").agg(F.max("c").alias("c")), "pairs")

    links = stash(verified(every, sets, percent), "links")
    label = stash(components(links), "labels")
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    named = rest.join(of("node"), "node", "left").select("node", "size", "rest", "digest", "prefix", F.coalesce("lnode", "node").alias("label"))
    across = _by_element(named, n).mapInArrow(_across(percent), "a long, b long")
    more = stash(verified(across.distinct(), sets, percent), "links")

    nodes = info.groupBy("node").agg(F.min("rep").alias("rep"))
    nodes = nodes.join(label.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln"), "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    if not more.isEmpty():  # these join components found before
        at = lambda c: of(c).select(F.col(c).alias("n"), f"l{c}")
        joined = more.join(at("u"), F.col("u") == F.col("n"), "left").drop("n").join(at("v"), F.col("v") == F.col("n"), "left")
        joined = components(joined.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
        nodes = nodes.join(joined.select(F.col("node").alias("ln"), F.col("label").alias("joined")), F.col("label") == F.col("ln"), "left").select("node", "rep", F.coalesce("joined", "label").alias("label"))
    nodes = stash(nodes, "nodes")
    discard(info, pairs, sets, single, often, info1, alike, frequent, every, links, label, more)
    least = nodes.groupBy("label").agg(F.min("rep").alias("component_id")).select(F.col("label").alias("cl"), "component_id")
    ids = stash(nodes.join(least, F.col("label") == F.col("cl")).select(F.col("node").alias("cn"), "component_id"), "components")
    rows = met.where("kind = 0").select(F.col("a").alias(key), F.col("b").alias("node"), F.col("c").alias("n_shingles"))
    rows = rows.join(ids, F.col("node") == F.col("cn"), "left")
    return rows.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))


def _repeats(sets: DataFrame) -> bool:
    """Whether a node's set is there twice, as where rows repeat a key."""
    r = sets.groupBy("node").count().agg(F.max("count")).collect()[0][0]
    return (r or 0) > 1


def _plausible(pairs: DataFrame, info: DataFrame, percent: int, also=None) -> DataFrame:
    """Pairs (a, b, c) whose sizes allow a link and that share as many signatures as a link demands, and for which ``also`` holds.

    Of a node's signatures, slack + k + 1 are in small groups; in a link at most as
    many as the elements in which the two sets differ are not shared.
    """
    of = lambda c: info.select(F.col("node").alias(c), F.col("band").alias("e"), F.col("size").alias(f"n{c}"), F.col("slack").alias(f"s{c}"))
    p = pairs.join(of("a"), ["a", "e"]).join(of("b"), ["b", "e"])
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    # slack was taken against the largest k of the node in its band, which is no less than this pair's
    enough = (F.col("c") >= F.col("sa") + 1) & (F.col("c") >= F.col("sb") + 1)
    p = p.where(fits & enough)
    return (p if also is None else p.where(also)).groupBy("a", "b").agg(F.max("c").alias("c"))


def _by_element(rows: DataFrame, n: int) -> DataFrame:
    """Rows with a prefix once for each bucket that its elements are in, with those elements and all (``every``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                s = np.frombuffer(r["prefix"], "<u8")
                out += [(k, r["node"], r["size"], r["rest"], r["digest"], s[x:y].tobytes(), r["label"], r["prefix"]) for k, x, y in cuts(s, n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()], strict=True)], names=["bucket", "node", "size", "rest", "digest", "prefix", "label", "every"])

    return deal(rows.mapInArrow(run, "bucket int, node long, size long, rest long, digest long, prefix binary, label long, every binary"), n)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its shingles and its component."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY ALL
"""
