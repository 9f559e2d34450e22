"""Connected components of links, in the shared folder; nothing of the links reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b), by alternating large-star and small-star.

    Each round at least halves the depth of the trees that links form, and every join key's rows combine before they move.
    """
    edges = links.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    edges = materialise(edges, "links")
    for r in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's least neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where(F.col("a") != F.col("b")).distinct(), "large")
        # small star: smaller neighbours and the node itself are linked to the least of them; a > b holds in large
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        small = materialise(small.where(F.col("a") != F.col("b")).distinct(), "small")
        # stars already: each node has one link, and no centre has a link downwards
        n, nodes, centres = small.agg(F.count("*"), F.countDistinct("a"), F.countDistinct("b")).first()
        edges = small
        if n == nodes and not small.select(F.col("b").alias("a")).distinct().join(small.select("a"), "a", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("links didn't settle; raise max_rounds")
    centre = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centre.select("node", F.col("node").alias("component")))
