"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.session import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge in (a, b); component is the smallest node reachable.

    Alternates large-star and small-star rounds, which need about log2(longest path) rounds, until nothing changes.
    Links are never gathered: each round is a grouped minimum and a join, and its result is written to the checkpoint
    folder. Self-loops are ignored; an empty table gives an empty result.
    """
    links = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(links)
    while True:
        links = checkpoint(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if before == state:
            break
    # every node now points straight at the smallest one of its component
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Count and order-free digests of the links; each round lowers the sum of v or leaves all as it is."""
    total = F.sum(F.col("v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), total, F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to its smallest neighbour, itself included."""
    both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    # spread anew, so that the join has an exchange on both sides and a node with very many links can be split
    joined = both.join(least.repartition("m", "node"), "node").where("other > node")
    return joined.select(F.col("other").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least.repartition("m", "u"), "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
