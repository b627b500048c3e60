"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved

#: Edges of one part of a round's tables: few edges are not spread over many tasks and files.
PART_EDGES = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first, so that Spark can split the edges of a node that has many
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is its least reachable node.

    Links are pairs of longs in any order; repeated links and loops do no harm. Without links the
    result is empty. Each round writes its edges to the checkpoint folder, in as many parts as their number
    asks for; only counts reach the driver.
    """
    edges = saved(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select("v", "v").toDF("node", "component").distinct()
            )
        seen, parts = now, -(-now[0] // PART_EDGES)
        edges = saved(_small_star(saved(_large_star(edges.coalesce(parts), parts).coalesce(parts)), parts).coalesce(parts))
