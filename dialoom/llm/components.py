"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node that ``links`` (a, b) names; the root is the smallest node reachable.

    Only minima per node are gathered, with partial aggregation, so a hub costs
    a row per task. Rounds go on until a round changes nothing; their number
    grows with the logarithm of the longest path. Null ends and loops are ignored.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = scratch.keep(links.where("a is not null and b is not null and a <> b").select(low.alias("a"), high.alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u <> v").distinct()
        large = scratch.keep(large, "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        after = scratch.keep(moved.union(small.select("m", "u")).distinct(), "edges")
        scratch.drop(large, edges)
        edges, before, state = after, state, _state(after)
        if before == state:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def extended_components(components: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``components`` (node, root) with further ``links`` (a, b), as ``connected_components`` of all links gives them.

    Only the roots that the links join are searched again: links inside a component fall out first, so that the
    rounds run over what is new. Nodes that no component has yet are their own root.
    """

    def rooted(pairs: DataFrame, end: str) -> DataFrame:
        known = components.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        return pairs.join(known, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))

    pairs = rooted(rooted(links.where("a is not null and b is not null"), "a"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    merged = scratch.keep(connected_components(pairs, scratch), "merged")
    moved = components.join(merged.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
    new = merged.join(components, "node", "left_anti").select("node", "root")
    return moved.select("node", F.coalesce("new", "root").alias("root")).union(new)


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())
