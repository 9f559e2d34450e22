"""What a loop over ordered pairs would decide, decided in rounds over tables.

A loop that takes pairs in a fixed order, each changing at most its two ends, gives the same if in a round every pair is taken that is the first
of all that are left at both of its ends: nothing before it touches either.  So a round settles pairs all over the table at once, no key's rows meet
in one task, and what a round leaves is written to the shared folder.  Pairs come from ``nearness``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .graphs import components


def _struct(columns: list[str]) -> Column:
    return F.struct(*columns)


def matched(pairs: DataFrame, left: list[str], right: list[str], best: list[str]) -> DataFrame:
    """The pairs that greedy one-to-one matching takes: by falling ``best`` (then by right and left key, also falling), each left and
    right key once.  A pair that is the best of both its ends is taken by any greedy order, so rounds of them are that matching."""
    rank = F.struct(*best, *[c for c in left if c not in right], *right)
    rest, out = pairs.withColumn("_rank", rank), None
    while True:
        rest = written(rest, "pairs")
        if rest.isEmpty():
            return pairs.limit(0) if out is None else out
        tops = [rest.groupBy(*keys).agg(F.max("_rank").alias(name)) for keys, name in ((left, "_l"), (right, "_r"))]
        taken = written(rest.join(tops[0], left).join(tops[1], right).where((F.col("_rank") == F.col("_l")) & (F.col("_rank") == F.col("_r"))).select(pairs.columns), "taken")
        out = taken if out is None else out.unionByName(taken)
        rest = rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti")


def _firsts(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs (by, a, b) whose key is the least of all pairs at both of their ends."""
    ends = pairs.select("by", F.explode(F.array("a", "b")).alias("end"), key).groupBy("by", "end").agg(F.min(key).alias("_k"))
    j = pairs
    for end, name in (("a", "_ka"), ("b", "_kb")):
        j = j.join(ends.select("by", F.col("end").alias(end), F.col("_k").alias(name)), ["by", end])
    return j.where((F.col(key) == F.col("_ka")) & (F.col(key) == F.col("_kb"))).drop("_ka", "_kb")


def survivors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes (by, node) without those that lose: pairs (by, a, b with a before b, loser) are taken by a, then b, unless one of both is gone,
    and the loser goes."""
    rest, gone = pairs.where("loser IS NOT NULL").select("by", "a", "b", "loser", F.struct("a", "b").alias("key")), None
    while True:
        rest = written(rest, "pairs")
        if rest.isEmpty():
            return nodes if gone is None else nodes.join(gone.withColumnRenamed("loser", "node"), ["by", "node"], "left_anti")
        lost = written(_firsts(rest, "key").select("by", "loser").distinct(), "gone")
        gone = lost if gone is None else gone.unionByName(lost)
        for end in ("a", "b"):
            rest = rest.join(lost.select("by", F.col("loser").alias(end)), ["by", end], "left_anti")


def leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """by, node and leader: in order of node each is a leader unless it is near an earlier one (pairs by, a, b, a before b), and else joins
    the first that it is near.  A node without an undecided earlier neighbour leads; what is near it follows."""
    open_, rest, lead = nodes.select("by", "node").distinct(), pairs.select("by", "a", "b").where("a < b").distinct(), None
    every = rest = written(rest, "pairs")
    while True:
        open_ = written(open_, "open")
        if open_.isEmpty():
            break
        now = written(open_.join(rest.select("by", F.col("b").alias("node")).distinct(), ["by", "node"], "left_anti"), "leaders")
        lead = now if lead is None else lead.unionByName(now)
        follow = rest.join(now.withColumnRenamed("node", "a"), ["by", "a"], "left_semi").select("by", F.col("b").alias("node")).distinct()
        decided = written(now.unionByName(follow), "decided")
        open_ = open_.join(decided, ["by", "node"], "left_anti")
        rest = rest.join(decided.withColumnRenamed("node", "a"), ["by", "a"], "left_anti").join(decided.withColumnRenamed("node", "b"), ["by", "b"], "left_anti")
        rest = written(rest, "pairs")
    if lead is None:
        return nodes.select("by", "node", F.col("node").alias("leader"))
    joins = every.join(lead.withColumnRenamed("node", "a"), ["by", "a"], "left_semi").groupBy("by", F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    return lead.select("by", "node", F.col("node").alias("leader")).unionByName(joins.join(lead, ["by", "node"], "left_anti"))


def first_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """by, node and group: in order of node each joins the first group that has a member near it (pairs by, a, b, a before b), or begins
    one of its own.  A node's group is the least beginning that it reaches over ever earlier neighbours; each round looks one further."""
    pairs = written(pairs.select("by", "a", "b").where("a < b").distinct(), "pairs")
    near = pairs.select("by", F.col("b").alias("node")).distinct()
    at = written(nodes.select("by", "node").distinct().join(near.withColumn("_n", F.lit(True)), ["by", "node"], "left").select("by", "node", F.when(F.col("_n").isNull(), F.col("node")).alias("group")), "groups")
    while True:
        offers = pairs.join(at.where("group IS NOT NULL").select("by", F.col("node").alias("a"), "group"), ["by", "a"]).groupBy("by", F.col("b").alias("node")).agg(F.min("group").alias("offer"))
        better = written(at.join(offers, ["by", "node"]).where("group IS NULL OR offer < group").select("by", "node", "offer"), "offers")
        if better.isEmpty():
            return at
        at = written(at.join(better, ["by", "node"], "left").select("by", "node", F.coalesce("offer", "group").alias("group")), "groups")


def _vetoed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of by, component, t, pair and a, members and their clusters: a node is seen under a mark at t, or two nodes ask to join (pair).
    What is held is a component's nodes with their marks; its pairs pass by."""
    now, root, marks = None, {}, {}

    def top(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    def done():
        return pd.DataFrame([(now[0], n, top(n)) for n in root], columns=["by", "node", "c"])

    for pdf in parts:
        for by, comp, a, b, mark, pair in zip(*(pdf[c].tolist() for c in ("by", "component", "a", "b", "mark", "pair"))):
            if (by, comp) != now:
                if root:
                    yield done()
                now, root, marks = (by, comp), {}, {}
            if not pair:
                root.setdefault(a, a)
                marks.setdefault(top(a), set()).add(mark)
                continue
            x, y = sorted((top(a), top(b)))
            if x != y and marks[x].isdisjoint(marks[y]):
                root[y] = x
                more = marks.pop(y)
                if len(more) > len(marks[x]):
                    marks[x], more = more, marks[x]
                marks[x] |= more
    if root:
        yield done()


def vetoed_clusters(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters of items that are near, but for those met together.  rows: by, item, mark (where it was met) and pos (the order of rows,
    distinct in a by); pairs: by, a, b (items, a may be b).  An item met for the first time asks the earlier ones near it to join, in their
    order; two clusters that have been met under one mark so far stay apart.  by, item and cluster (the pos of its first item's first row).

    A pair is asked at the later one's first row.  One whose items have a mark in common by then is refused for good, as clusters only grow.
    Where no mark of a whole component occurs twice, all of it joins at once; the rows and pairs of any other pass through a task in
    their order: a name that most others are near has a pair settled after another, which would take as many rounds as it has pairs."""
    seen = rows.groupBy("by", "item", "mark").agg(F.min("pos").alias("pos"))
    items = written(seen.groupBy("by", "item").agg(F.min("pos").alias("first"), F.collect_list(F.struct(F.struct("mark").alias("mark"), "pos")).alias("marks")), "items")
    ends = [items.select("by", F.col("item").alias(c), F.col("first").alias(f"f{c}"), F.col("marks").alias(f"m{c}")) for c in "ab"]
    by_then = lambda m: F.transform(F.filter(m, lambda x: x["pos"] <= F.col("fb")), lambda x: x["mark"])
    asked = pairs.join(ends[0], ["by", "a"]).join(ends[1], ["by", "b"]).where("fa < fb").where(~F.arrays_overlap(by_then("ma"), by_then("mb")))
    # items go by their first row
    rest = written(asked.select("by", F.col("fa").alias("a"), F.col("fb").alias("b")).distinct(), "pairs")
    node = lambda c: F.struct("by", F.col(c).alias("n"))
    comp = written(components(rest.select(node("a").alias("a"), node("b").alias("b"))).select("node.by", F.col("node.n").alias("node"), F.col("component.n").alias("component")), "components")
    held = comp.join(items.select("by", F.col("first").alias("node"), F.explode("marks").alias("m")), ["by", "node"]).select("by", "component", "node", F.col("m.mark.mark").alias("mark"), F.col("m.pos").alias("pos"))
    twice = written(held.groupBy("by", "component", "mark").count().where("count > 1").select("by", "component").distinct(), "twice")
    held, links = held.join(twice, ["by", "component"]), rest.join(comp.withColumnRenamed("node", "a"), ["by", "a"]).join(twice, ["by", "component"])
    kind = {c: held.schema[c].dataType for c in ("by", "component")}
    # no number is null, so that none turns into a double in pandas
    events = held.select("by", "component", F.col("pos").alias("t"), F.col("node").alias("a"), F.col("node").alias("b"), F.col("mark").cast("string").alias("mark"), F.lit(False).alias("pair"))
    events = events.unionByName(links.select("by", "component", F.col("b").alias("t"), "a", "b", F.lit(None).cast("string").alias("mark"), F.lit(True).alias("pair")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = events.repartition(tasks, "by", "component").sortWithinPartitions("by", "component", "t", "pair", "a")
    pos = kind["component"].simpleString()
    split = events.mapInPandas(_vetoed, f"by {kind['by'].simpleString()}, node {pos}, c {pos}")
    whole = comp.join(twice, ["by", "component"], "left_anti").select("by", "node", F.col("component").alias("c"))
    c = whole.unionByName(split).withColumnRenamed("node", "first")
    return items.join(written(c, "clusters"), ["by", "first"], "left").select("by", "item", F.coalesce("c", "first").alias("cluster"))
