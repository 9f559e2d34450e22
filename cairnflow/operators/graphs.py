"""Graphs as tables of links: roots of forests and components, by joins alone; tables between rounds are in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def roots(parents: DataFrame) -> DataFrame:
    """node and root of each node of a forest (node, parent): a node's parent becomes its parent's parent until all are roots, so a
    path of length n takes log n rounds.  Nodes are compared as they are; no node has two parents or is null."""
    at = parents.select("node", F.col("parent").alias("root"))
    while True:
        at = written(at, "roots")
        up = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if at.join(up, "root", "left_semi").isEmpty():
            return at
        at = at.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links reach) of each node of links (a, b): every node takes the smallest of its own,
    its neighbours' and its label's labels, and labels are followed to their ends after each round, so long paths take few rounds."""
    both = links.where(F.col("a") != F.col("b")).select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("node"), "c"), "labels")
    while True:
        # the least label of a node's neighbours is offered to the node's own label, which is a node too
        near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        offers = label.join(near, F.col("node") == F.col("a")).where(F.col("near") < F.col("c")).select(F.col("c").alias("node"), F.col("near").alias("to"))
        offers = written(offers.groupBy("node").agg(F.min("to").alias("to")), "offers")
        if offers.isEmpty():
            return label.select("node", F.col("c").alias("component"))
        # offers go from greater to smaller labels: a forest, whose roots are the new labels
        ends = roots(offers.select("node", F.col("to").alias("parent"))).select(F.col("node").alias("c"), "root")
        label = written(label.join(ends, "c", "left").select("node", F.coalesce("root", "c").alias("c")), "labels")
