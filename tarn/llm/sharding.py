"""Sharding by minimax contiguous partition.

Rows with equal texts form a group, the atomic unit; groups are ordered by a hash of
the text. The smallest capacity at which a greedy sweep needs no more shards than
asked is found by binary search, and shards are cut within it. The driver never sees
all groups: it holds the sizes of ranges of the hash, at first 65,536 of them, and
asks for finer ranges only where a greedy cut can fall at some capacity that is still
possible, until no such range has more than one group. The capacity and the cuts are
then those of the groups themselves.

Within the least capacity shards are cut where they are most even: a sweep that fills
each up to the capacity would leave the last one short by all that the others hold
beyond an even share. A group larger than an even share, such as that of a text with
very many copies, first gets a shard of its own, for the same reason.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.store import stash

#: Ranges of the hash whose sizes the driver asks for at once, about.
RANGES = 1 << 16
SHARDS = 40
#: Added to the UTF-8 bytes of each text.
ROW_BYTES = 16
#: Parts of a shard within which rows are ranked; a shard of a billion rows has a million in each.
PARTS = 1024


def capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity with which ``sizes``, in order, fit into so many contiguous shards."""
    upto = [0, *accumulate(sizes)]

    def fits(cap: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(upto, upto[at] + cap) - 1
            if at == len(sizes):
                return True
        return False

    low, high = max(max(sizes, default=0), -(-upto[-1] // max(shards, 1))), upto[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def even_cuts(sizes: list[int], shards: int, cap: int) -> list[int]:
    """Where the later shards begin: within ``cap``, where the greedy check still allows it, nearest to even shares."""
    n, upto = len(sizes), [0, *accumulate(sizes)]
    reach = [bisect_right(upto, upto[i] + cap) - 1 for i in range(n + 1)]
    need = [0] * (n + 1)  # shards that the groups from i on need, checked greedily
    for i in reversed(range(n)):
        need[i] = 1 + need[reach[i]]
    cuts, at = [], 0
    for more in range(shards - 1, 0, -1):
        low = max(bisect_left(need, -more, key=lambda x: -x), at)
        high = max(min(reach[at], n - more), low)
        share = upto[at] + (upto[-1] - upto[at]) / (more + 1)
        j = bisect_left(upto, share, low, high)
        at = j - 1 if j > max(low, at + 1) and share - upto[j - 1] <= upto[j] - share else j
        if at >= n:
            break
        if at:
            cuts.append(at)
    return cuts


def own_shards(largest: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Hashes of groups (hash, size), largest first, that get a shard of their own: those above an even share of what is left."""
    own: list[int] = []
    for h, size in largest:
        if len(own) == shards - 1 or size * (shards - len(own)) <= total or size == total:
            break
        own.append(h)
        total -= size
    return own


@dataclass(frozen=True)
class Range:
    """The groups whose hash begins with the ``bits`` bits ``prefix`` (a signed number): their size and number."""

    prefix: int
    bits: int
    size: int
    groups: int

    @property
    def start(self) -> int:
        return self.prefix << (64 - self.bits)


def unresolved(ranges: list[Range], shards: int) -> list[int]:
    """Positions of the ranges, of more than one group, that a cut may part."""
    sizes = [r.size for r in ranges]
    upto = [0, *accumulate(sizes)]
    total = upto[-1]
    most = capacity(sizes, shards)  # whole ranges fit, so groups do
    least = max(max((r.size for r in ranges if r.groups == 1), default=0), -(-total // shards))
    found, at, cuts = set(), 0, even_cuts(sizes, shards, most)
    found |= {i for c in cuts for i in (c - 1, c)}
    for j in range(1, shards):
        # no capacity cuts the j-th shard before whole ranges at the least one do, or after j of the most
        at = bisect_right(upto, upto[at] + least) - 1
        share = bisect_right(upto, total * j / shards) - 1
        last = min(bisect_left(upto, j * most), len(ranges) - 1)
        found |= set(range(min(at, share), max(last, share) + 1)) if at < len(ranges) else set()
    found |= {i for i, r in enumerate(ranges) if r.size > least}
    return sorted(i for i in found if 0 <= i < len(ranges) and ranges[i].groups > 1 and ranges[i].bits < 64)


def partition(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(hashes with a shard of their own, hashes at which the later shards of the others begin) for (h, size), one row for each group.

    Shards of single groups come first; the shard of any other group is their
    number plus the number of later shards that begin at or before it. The driver
    gets about ``RANGES`` rows a round.
    """
    total = groups.agg(F.sum("size")).collect()[0][0] or 0
    largest = [(r["h"], r["size"]) for r in groups.where(F.col("size") * shards > total).orderBy(F.desc("size"), "h").limit(shards).collect()]
    # shares shrink as groups leave, so a group at most that large may follow
    if largest:
        largest = [(r["h"], r["size"]) for r in groups.orderBy(F.desc("size"), "h").limit(shards).collect()]
    own = own_shards(largest, total, shards)
    rest = groups.where(~F.col("h").isin(own)) if own else groups
    left = shards - len(own)

    def ask(d: DataFrame, prefix: Column, bits: int | None = None) -> list[Range]:
        got = d.groupBy(prefix.alias("p"), *([] if bits else ["bits"])).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups")).collect()
        return [Range(r["p"], bits or r["bits"], r["size"], r["groups"]) for r in got]

    bits = RANGES.bit_length() - 1
    ranges = sorted(ask(rest, F.shiftright("h", 64 - bits), bits), key=lambda r: r.start)
    while todo := unresolved(ranges, left):
        more = max(1, bits - len(todo).bit_length())
        parts = [ranges[i] for i in todo]
        finer = []
        for depth in sorted({r.bits for r in parts}):
            own_prefix, now = F.shiftright("h", 64 - depth), min(64, depth + more)
            finer += ask(rest.where(own_prefix.isin([r.prefix for r in parts if r.bits == depth])), F.shiftright("h", 64 - now), now)
        gone = set(todo)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in gone] + finer, key=lambda r: r.start)
    sizes = [r.size for r in ranges]
    return own, [ranges[c].start for c in even_cuts(sizes, left, capacity(sizes, left))]


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    Rows with equal texts (null equals empty) are in one shard; sizes of shards
    are as even as whole groups allow. Slots number the rows of a shard from 0 by
    part and key. Fewer groups than shards leave shards empty; an empty table gives
    no row. Repeated rows are rows of their own; null keys come first in their
    part. Texts that share a 64-bit hash are one group. A text of any length is one
    row of its size. Extra columns are not carried, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.select(F.col(key).alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"), F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS)).cast("int").alias("part"))
    d = stash(d, "shard-sizes")  # texts are read once
    own, cuts = partition(stash(d.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups"), shards)
    d = d.withColumn("shard", _shard_of(F.col("h"), own, cuts))
    counts = d.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * PARTS rows
    counts = counts.select(F.col("shard").alias("_s"), F.col("part").alias("_p"), (F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    d = d.withColumn("inside", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "h")) - 1)
    d = d.join(counts, (F.col("shard") == F.col("_s")) & (F.col("part") == F.col("_p")))
    return d.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"))


def _shard_of(h: Column, own: list[int], cuts: list[int]) -> Column:
    """At most one branch or comparison for each shard."""
    out = F.lit(len(own))
    for c in cuts:
        out = out + (h >= F.lit(c)).cast("int")
    for i, c in enumerate(own):
        out = F.when(h == F.lit(c), F.lit(i)).otherwise(out)
    return out.cast("int")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
