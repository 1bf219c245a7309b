"""Connected components by alternating large and small stars, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import cut, released


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node of its component.

    Each round hooks every node's larger (then smaller) neighbours to its least
    neighbour, a grouped minimum that combines before the shuffle, so a hub costs
    no more than its edges. The rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        with released(e.sparkSession):
            now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after more links (a, b): only the roots that the links join go through the rounds again."""
    links = cut(links)
    if links.isEmpty():
        return roots
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
    nodes = cut(roots.union(fresh.select("node", F.col("node").alias("root"))))
    at = lambda x: nodes.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    top = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    moved = nodes.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return cut(moved.select("node", F.coalesce("top", "root").alias("root")))
