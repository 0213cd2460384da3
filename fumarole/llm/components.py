"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumarole.session import materialise


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    stars = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return stars.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) links that is not itself the smallest of its
    component; ``root`` is that smallest node.

    Each round is written as a stage table, so a lost executor costs one round at most; the
    driver only sees a count and a checksum. Minima are taken before rows move, so a node with
    many neighbours is aggregated in the map tasks and its rows are split by the skew join.
    Null nodes and links of a node to itself are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialise(edges.where("a is not null and b is not null and a <> b").distinct(), "links")
    seen = None
    while True:
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count("*"), total).first())
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        edges = materialise(small_star(large_star(edges)), "links")
