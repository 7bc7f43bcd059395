"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.store import discard, stash

#: Nodes with more than one in so many of all edges: no more than twice as many can be, so their leasts are broadcast.
HUBS = 1000


def _with_least(e: DataFrame, of: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(``e`` with the least neighbour ``m`` of u in ``of``; all (u, m)), u's neighbours in ``of`` being v.

    The edges of a hub meet its least where they are; only those of other nodes are
    dealt by node, and no node has many of these.
    """
    least = of.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("c"), "m", "n")
    many = F.col("n") > count // HUBS
    hubs = least.where(many).drop("n")  # at most 2 * HUBS rows of 16 bytes
    here = e.join(F.broadcast(hubs), F.col("u") == F.col("c"))
    other = e.join(F.broadcast(hubs.select("c")), F.col("u") == F.col("c"), "left_anti").join(least.where(~many).drop("n"), F.col("u") == F.col("c"))
    columns = ["u", "v", "m"]
    return here.select(columns).unionByName(other.select(columns)), least.select(F.col("c").alias("u"), "m")


def _large(e: DataFrame, count: int) -> DataFrame:
    """Each node sends its larger neighbours the least node of its neighbourhood, itself included."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up, _ = _with_least(both.where("v > u"), both, 2 * count)
    return up.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(e: DataFrame, count: int) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, the least of them."""
    down, least = _with_least(e, e, count)
    return down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v): the label is the component's least node.

    Both stars are groupings by node with partial aggregation, and joins that no hub
    is gathered for; rounds grow with the logarithm of the longest path. Loops and
    repeated edges do no harm; without an edge there is no row.
    """
    state = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0])
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stash(e, "edges")
    now, before = state(e), None
    for _ in range(rounds):
        if now == before or not now[0]:
            break
        large = stash(_large(e, now[0]).distinct(), "edges")
        small = stash(_small(large, large.count()).distinct(), "edges")
        discard(e, large)
        e, before = small, now
        now = state(e)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
