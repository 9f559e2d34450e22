"""Exact quantiles by refinement of ranges, in bounded state however large a group is and however many values it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BINS = 4096


def exact_quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], bins: int = BINS) -> DataFrame:
    """by and q, the interpolated quantiles of value in the order of probs.  Nulls and NaNs are left out; a group of nothing else has no row.

    A quantile lies between two ranks.  The range of a rank is cut in even bins, which are counted, with their least and greatest
    values, by rows that combine before they move; the bin that holds the rank is its next range.  A range of one value is the
    answer, so each pass looks at a few thousandths of the rows of the one before, and no task holds more than a group's bins.  Passes are as many as
    the logarithm, to the base of bins, of a group's range over the gaps in it."""
    g, v = F.struct(*by) if by else F.struct(F.lit(0)), F.col(value).cast("double")
    base = rows.select(g.alias("g"), v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = written(base.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "ends")
    asked = ends.select("g", "n", "lo", "hi", F.posexplode(F.array(*map(F.lit, probs))).alias("i", "p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    asked = written(asked.select("g", "lo", "hi", "i", F.floor("at").alias("k"), (F.col("at") - F.floor("at")).alias("part")), "asked")
    ranks = asked.select("g", "lo", "hi", F.explode(F.array_distinct(F.array("k", F.col("k") + (F.col("part") > 0).cast("int")))).alias("k")).distinct()
    known, left = ranks.where("lo = hi"), ranks.where("lo < hi").withColumn("before", F.lit(0).cast("long"))
    left = written(left, "ranges")
    found = [known.select("g", "k", F.col("lo").alias("x"))]
    w = Window.partitionBy("g", "lo", "hi").orderBy("bin")
    while not left.isEmpty():
        ranges = left.select("g", "lo", "hi").distinct()
        step = (F.col("hi") / bins) - (F.col("lo") / bins)
        # a range so narrow that its bins have no width has two bins: its least value, and what is over it
        bin_ = F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / step))).otherwise((F.col("v") > F.col("lo")).cast("long"))
        counted = base.join(ranges, "g").where("v BETWEEN lo AND hi").groupBy("g", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        counted = counted.withColumn("upto", F.sum("c").over(w))
        j = left.join(counted, ["g", "lo", "hi"]).where((F.col("k") < F.col("before") + F.col("upto")) & (F.col("k") >= F.col("before") + F.col("upto") - F.col("c")))
        now = written(j.select("g", F.col("a").alias("lo"), F.col("b").alias("hi"), "k", (F.col("before") + F.col("upto") - F.col("c")).alias("before")), "ranges")
        found.append(now.where("lo = hi").select("g", "k", F.col("lo").alias("x")))
        left = now.where("lo < hi")
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    below = asked.join(values, ["g", "k"]).select("g", "i", "k", "part", "x")
    above = values.select("g", (F.col("k") - 1).alias("k"), F.col("x").alias("y"))
    j = below.join(above, ["g", "k"], "left").select("g", F.struct("i", F.when(F.col("part") > 0, F.col("x") + (F.col("y") - F.col("x")) * F.col("part")).otherwise(F.col("x")).alias("x")).alias("q"))
    out = j.groupBy("g").agg(F.transform(F.sort_array(F.collect_list("q")), lambda q: q["x"]).alias("q"))
    return out.select(*[F.col("g")[c].alias(c) for c in by], "q")
