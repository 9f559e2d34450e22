"""Joins and set operations of intervals.

An overlap predicate alone would be planned as a nested loop over all pairs.  Here both sides are dealt to time buckets of a
given width, joined by (key, bucket) with a hash or sort-merge join, and a pair is kept only in the bucket in which its overlap
starts, so no pair comes twice and nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import overlap, time_iou


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width))))


def overlap_pairs(left: DataFrame, right: DataFrame, by: str, width: float = 60.0, inclusive: bool = False) -> DataFrame:
    """All pairs of rows of left (by, ls, le, ...) and right (by, rs, re, ...) whose intervals overlap; touching ones if inclusive."""
    a = left.withColumn("_b", _buckets(F.col("ls"), F.col("le"), width))
    b = right.withColumn("_b", _buckets(F.col("rs"), F.col("re"), width))
    if inclusive:
        meets = (F.col("ls") <= F.col("re")) & (F.col("rs") <= F.col("le"))
    else:
        meets = (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le"))
    here = F.col("_b") == F.floor(F.greatest("ls", "rs") / width)
    return a.join(b, [by, "_b"]).where(meets & here).drop("_b")


def best_overlap(left: DataFrame, right: DataFrame, by: str, left_id: str, right_order: list[str], value: str, min_ratio: float = 0.5, width: float = 60.0) -> DataFrame:
    """Each left row with the value of the right row that overlaps it most, the first in right_order of equals; null where the overlap is
    under min_ratio of the left interval or there is none."""
    pairs = overlap_pairs(left, right, by, width).withColumn("_o", overlap(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")))
    # the greatest of (overlap, reversed order) by one aggregation, not a sort of each left row's pairs
    best = pairs.groupBy(left_id).agg(F.max_by(F.struct(value, "_o"), F.struct(F.col("_o"), *[-F.col(c) for c in right_order])).alias("_best"))
    out = left.join(best, left_id, "left")
    span = F.col("le") - F.col("ls")
    enough = (span > 0) & (F.col("_best._o") / span >= min_ratio)
    return out.withColumn(value, F.when(enough, F.col(f"_best.{value}"))).withColumn("overlap", F.coalesce(F.col("_best._o"), F.lit(0.0))).drop("_best")


def point_in(points: DataFrame, spans: DataFrame, by: str, width: float = 60.0) -> DataFrame:
    """Pairs of points (by, t, ...) and spans (by, rs, re, ...) with rs <= t <= re."""
    a = points.withColumn("_b", F.floor(F.col("t") / width))
    b = spans.withColumn("_b", _buckets(F.col("rs"), F.col("re"), width))
    return a.join(b, [by, "_b"]).where((F.col("rs") <= F.col("t")) & (F.col("t") <= F.col("re"))).drop("_b")


def match_with_fallback(events: DataFrame, records: DataFrame, by: str, event_id: str, refine: Column, width: float = 60.0) -> DataFrame:
    """Records within each event's interval that also meet refine; all of the interval where none does."""
    p = point_in(records, events, by, width).withColumn("_hit", F.coalesce(refine, F.lit(False)))
    any_hit = F.max("_hit").over(Window.partitionBy(event_id))
    return p.withColumn("_any", any_hit).where(F.col("_hit") | ~F.col("_any")).withColumn("refined", F.col("_any")).drop("_hit", "_any")


def nearest_span(points: DataFrame, spans: DataFrame, by: str, point_id: str, span_order: str) -> DataFrame:
    """For each interval of points (by, ls, le): the first span that holds its midpoint, else the one with most overlap, else the one whose
    edge is nearest.  Spans of a key that hold or touch the point are found by bucket; only points without any are matched with the
    neighbours before and after, found by two as-of windows."""
    p = points.withColumn("mid", (F.col("ls") + F.col("le")) / 2)
    inside = point_in(p.withColumn("t", F.col("mid")), spans, by).drop("t").withColumn("rank", F.lit(0)).withColumn("cost", F.lit(0.0))
    over = overlap_pairs(p, spans, by).withColumn("rank", F.lit(1)).withColumn("cost", -overlap(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")))
    # as-of: the last span that ends before the midpoint and the first that starts after it
    marks = p.select(by, F.col("mid").alias("at"), F.struct(point_id, "ls", "le", "mid").alias("p"), F.lit(None).cast("struct<rs:double,re:double,o:bigint>").alias("s"))
    ends = spans.select(by, F.col("re").alias("at"), F.lit(None).cast(marks.schema["p"].dataType).alias("p"), F.struct(F.col("rs").cast("double").alias("rs"), F.col("re").cast("double").alias("re"), F.col(span_order).cast("long").alias("o")).alias("s"))
    starts = spans.select(by, F.col("rs").alias("at"), F.lit(None).cast(marks.schema["p"].dataType).alias("p"), F.struct(F.col("rs").cast("double").alias("rs"), F.col("re").cast("double").alias("re"), F.col(span_order).cast("long").alias("o")).alias("s"))
    before = marks.unionByName(ends).withColumn("near", F.last("s", True).over(Window.partitionBy(by).orderBy("at", F.col("p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)))
    after = marks.unionByName(starts).withColumn("near", F.first("s", True).over(Window.partitionBy(by).orderBy("at", F.col("p").isNull()).rowsBetween(0, Window.unboundedFollowing)))
    near = before.unionByName(after).where(F.col("p").isNotNull() & F.col("near").isNotNull()).select(by, "p.*", F.col("near.rs").alias("rs"), F.col("near.re").alias("re"), F.col("near.o").alias(span_order)).withColumn("rank", F.lit(2)).withColumn("cost", F.least(F.abs(F.col("mid") - F.col("rs")), F.abs(F.col("mid") - F.col("re"))))
    cols = [by, point_id, "ls", "le", "rs", "re", span_order, "rank", "cost"]
    found = inside.select(cols).unionByName(over.select(cols)).unionByName(near.select(cols))
    return found.groupBy(point_id).agg(F.min_by(F.struct(span_order, "rank"), F.struct("rank", "cost", span_order)).alias("m")).select(point_id, f"m.{span_order}", "m.rank")


def duplicate_pairs(segments: DataFrame, by: str, seg_id: str, tokens: str, min_iou: float = 0.6, min_jaccard: float = 0.85, min_seconds: float = 0.5, min_tokens: int = 3) -> DataFrame:
    """Pairs of segments of different channels and one language that overlap in time and words; a before b by (start, end, channel)."""
    long = segments.where((F.col("e") - F.col("s") >= min_seconds) & (F.size(tokens) >= min_tokens))
    a = long.select(by, F.col("s").alias("ls"), F.col("e").alias("le"), F.col(seg_id).alias("a"), F.col("channel").alias("ca"), F.col("language").alias("la"), F.col(tokens).alias("ta"), F.col("score").alias("sa"))
    b = long.select(by, F.col("s").alias("rs"), F.col("e").alias("re"), F.col(seg_id).alias("b"), F.col("channel").alias("cb"), F.col("language").alias("lb"), F.col(tokens).alias("tb"), F.col("score").alias("sb"))
    from ..functions.similarity import jaccard

    p = overlap_pairs(a, b, by).where((F.col("ca") != F.col("cb")) & F.col("la").eqNullSafe(F.col("lb")))
    p = p.where(F.struct("ls", "le", "ca", "a") < F.struct("rs", "re", "cb", "b"))
    p = p.withColumn("iou", time_iou(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))).withColumn("jaccard", jaccard(F.col("ta"), F.col("tb")))
    return p.where((F.col("iou") >= min_iou) & (F.col("jaccard") >= min_jaccard))


def uncovered(wanted: DataFrame, cover: DataFrame, by: str, tolerance: float = 0.0, width: float = 60.0) -> DataFrame:
    """The parts of wanted's intervals (by, s, e) that no interval of cover (by, s, e), widened by tolerance, covers."""
    c = cover.where(F.col("e") > F.col("s")).select(by, F.greatest(F.lit(0.0), F.col("s") - tolerance).alias("s"), F.greatest(F.lit(0.0), F.col("e") + tolerance).alias("e"))
    c = coalesce(c, by)
    w = wanted.where(F.col("e") > F.col("s")).select(by, F.col("s").alias("ls"), F.col("e").alias("le")).distinct()
    hits = overlap_pairs(w, c.select(by, F.col("s").alias("rs"), F.col("e").alias("re")), by, width)
    inside = hits.groupBy(by, "ls", "le").agg(F.sort_array(F.collect_list(F.struct("rs", "re"))).alias("c"))  # of one interval, disjoint
    w = w.join(inside, [by, "ls", "le"], "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<rs:double,re:double>>")))
    starts = F.concat(F.array("ls"), F.transform("c", lambda x: x["re"]))
    ends = F.concat(F.transform("c", lambda x: x["rs"]), F.array("le"))
    gaps = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda g: g["e"] > g["s"])
    return w.select(by, F.inline(gaps))


def coalesce(spans: DataFrame, by: str, gap: float = 0.0) -> DataFrame:
    """Intervals (by, s, e) with those that overlap, or lie within gap, made one; n of them, and the seconds that they sum to."""
    w = Window.partitionBy(by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("s") - reach > gap)).cast("int")
    d = spans.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(by, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("seconds")).drop("_g")


def repair_chunks(chunks: DataFrame, gaps: DataFrame, by: str, preroll: float, postroll: float) -> DataFrame:
    """Gaps widened by pre- and postroll and clipped to the chunks that they overlap, those of a chunk made one where they meet."""
    p = overlap_pairs(chunks, gaps, by)
    clipped = p.select(by, "chunk", F.greatest("ls", F.col("rs") - preroll).alias("s"), F.least("le", F.col("re") + postroll).alias("e")).where("e > s")
    return coalesce(clipped.withColumn("_k", F.struct(by, "chunk")).drop(by, "chunk"), "_k").select(f"_k.{by}", "_k.chunk", "s", "e")


def tile(spans: DataFrame, by: str, width: float) -> DataFrame:
    """Windows of width from each key's least s to its greatest e; the last one is cut."""
    t = spans.groupBy(by).agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    t = t.withColumn("w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / width).cast("int") - 1))))
    return t.select(by, "w", (F.col("lo") + F.col("w") * width).alias("s"), F.least("hi", F.col("lo") + (F.col("w") + 1) * width).alias("e"))


def sliding(lengths: DataFrame, by: str, width: float = 28.0, lap: float = 2.0) -> DataFrame:
    """Windows of width that overlap by lap over [0, length) of each key; the last one is cut."""
    step = width - lap
    n = F.when(F.col("length") <= width, 1).otherwise(1 + F.ceil((F.col("length") - width) / step).cast("int"))
    t = lengths.where("length > 0").withColumn("w", F.explode(F.sequence(F.lit(0), n - 1)))
    return t.select(by, "w", (F.col("w") * step).alias("s"), F.least(F.col("length"), F.col("w") * step + width).alias("e"))
