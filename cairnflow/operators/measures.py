"""Distributions, shares, rollups and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def stats(rows: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """count, min, quartiles and tails, max, mean, population deviation of each group, in bounded state."""
    q = exact_quantiles(rows, by, value, [0.05, 0.25, 0.5, 0.75, 0.95])
    a = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    same = F.lit(True)
    for c in by:
        same = same & a[c].eqNullSafe(q[c])
    names = ["p5", "p25", "median", "p75", "p95"]
    return a.join(q, same, "left").select(*[a[c] for c in by], "n", *[F.round(F.col("q")[k], digits).alias(n) for k, n in enumerate(names)], F.round("min", digits).alias("min"), F.round("max", digits).alias("max"), F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"))


def shares(rows: DataFrame, key: str, weight: Column, digits: int = 6) -> DataFrame:
    """Each key's share of the weight."""
    a = rows.groupBy(key).agg(F.sum(weight).alias("weight"))
    total = a.agg(F.sum("weight").alias("_total"))
    return a.join(F.broadcast(total)).withColumn("share", F.round(F.col("weight") / F.col("_total"), digits)).drop("_total")  # one row


def dominant(shared: DataFrame, key: str, least: float, but: list[str]) -> DataFrame:
    """The key with the greatest share that isn't among but, if it has at least least; the alphabetically first of equals."""
    a = shared.where(~F.col(key).isin(*but)).agg(F.min_by(F.struct(key, "share"), F.struct(-F.col("share"), F.col(key))).alias("m"))
    return a.select(F.when(F.col("m.share") >= least, F.col(f"m.{key}")).alias(key), F.col("m.share").alias("share"))


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group; the least of equals."""
    return rows.groupBy(by, value).count().groupBy(by).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value), F.max("count").alias("n"))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts in [edge, next), the last bucket closed; values outside are dropped."""
    last = len(edges) - 2
    bucket = F.coalesce(*[F.when((value >= a) & ((value <= b) if k == last else (value < b)), F.lit(k)) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    return rows.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").count()


def each_dimension(rows: DataFrame, dims: list[str], *aggs: Column) -> DataFrame:
    """One grouping for each dimension, in one pass: dimension, value and the aggregates."""
    long = rows.select("*", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])))
    return long.groupBy("dimension", "value").agg(*aggs)


def weighted(rows: DataFrame, by: str, metrics: list[str], weight: str, floor: float = 0.001) -> DataFrame:
    w = F.greatest(F.lit(floor), F.col(weight))
    return rows.groupBy(by).agg(*[(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in metrics])


def top_terms(words: DataFrame, term: str, k: int) -> DataFrame:
    return words.groupBy(term).count().orderBy(F.desc("count"), term).limit(k)


def ngram_model(names: DataFrame, name: str, n: int = 3) -> DataFrame:
    """gram, its count and that of its first n - 1 characters, over names padded by ^ and $."""
    s = F.concat(F.lit("^" * (n - 1)), F.lower(F.col(name)), F.lit("$"))
    g = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda k: F.substring(s, k, F.lit(n)))).alias("gram"))
    g = g.groupBy("gram").agg(F.count("*").alias("n")).withColumn("context", F.substring("gram", 1, n - 1))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy("context")))


def ngram_score(names: DataFrame, name: str, model: DataFrame, n: int = 3, k: float = 0.5, size: int = 30) -> DataFrame:
    """Mean log probability of each name's grams with additive smoothing."""
    s = F.concat(F.lit("^" * (n - 1)), F.lower(F.col(name)), F.lit("$"))
    g = names.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).alias("gram")).withColumn("context", F.substring("gram", 1, n - 1))
    contexts = model.select("context", "total").distinct()
    j = g.join(model.select("gram", "n"), "gram", "left").join(contexts, "context", "left")
    p = (F.coalesce("n", F.lit(0)) + k) / (F.coalesce("total", F.lit(0)) + k * size)
    return j.groupBy(name).agg(F.avg(F.log(p)).alias("score"))


def precision_recall(rows: DataFrame, by: list[str], truth: Column, guess: Column, digits: int = 6) -> DataFrame:
    tp, fp, fn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)
    a = rows.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    safe = lambda c, d: F.round(F.when(d > 0, c).otherwise(0.0), digits)
    return a.select(*by, "tp", "fp", "fn", safe(p, F.col("tp") + F.col("fp")).alias("precision"), safe(r, F.col("tp") + F.col("fn")).alias("recall"), safe(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def deltas(rows: DataFrame, by: str, variant: str, base: str, metric: str) -> DataFrame:
    """metric less that of the group's base variant."""
    b = F.max(F.when(F.col(variant) == base, F.col(metric))).over(Window.partitionBy(by))
    return rows.withColumn("delta", F.col(metric) - b)


def column_split(boxes: DataFrame, by: str, y: str, x: str, w: str, tolerance: float, least_gap: float, least_rows: int = 3) -> DataFrame:
    """The x that splits two columns: the median middle of the gaps between neighbours in a line; null under least_rows lines."""
    win = Window.partitionBy(by, "_y").orderBy(x)
    g = boxes.withColumn("_y", F.floor(F.col(y) / tolerance)).withColumn("_next", F.lead(x).over(win))
    gap = F.col("_next") - (F.col(x) + F.col(w))
    mids = g.where(gap >= least_gap).groupBy(by, "_y").agg(F.max_by((F.col("_next") + F.col(x) + F.col(w)) / 2, gap).alias("mid"))
    return mids.groupBy(by).agg(F.percentile("mid", 0.5).alias("split"), F.count("*").alias("lines")).select(by, F.when(F.col("lines") >= least_rows, F.col("split")).alias("split"), "lines")


def box_union(boxes: DataFrame, by: str) -> DataFrame:
    """The smallest box (x, y, w, h) around each key's boxes."""
    right, below = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (below - F.min("y")).alias("h"))


def garble_verdict(scores: Column, solo: float, pair: float) -> Column:
    """Whether a name is garbled by its tokens' scores: one under solo, or two under pair."""
    under = lambda least: F.size(F.filter(scores, lambda x: x < least))
    return (under(solo) >= 1) | (under(pair) >= 2)


def direction_votes(births: DataFrame, by: str, t: str, y: str, seconds: float = 0.25, pixels: float = 8.0) -> DataFrame:
    """How surely tracks that are born one after another move one way: votes of neighbours that are far enough apart in time and place,
    their agreement times their support (five votes are full); 0 under three births or two votes."""
    w = Window.partitionBy(by).orderBy(t, y)
    d = births.select(by, t, y, (F.col(t) - F.lag(t).over(w)).alias("_t"), (F.col(y) - F.lag(y).over(w)).alias("_y"))
    vote = F.when((F.col("_t") >= seconds) & (F.abs("_y") >= pixels), F.signum("_y"))
    a = d.groupBy(by).agg(F.count("*").alias("births"), F.count(vote).alias("votes"), F.count_if(vote > 0).alias("down"))
    agree = F.greatest("down", F.col("votes") - F.col("down")) / F.col("votes")
    return a.select(by, "votes", F.when((F.col("births") < 3) | (F.col("votes") < 2), 0.0).otherwise(F.round(agree * F.least(F.lit(1.0), F.col("votes") / 5), 4)).alias("hint"))


def sample_schedule(frames: Column, proposals: Column, fps: float = 1.5, stride: float = 15.0, tail: float = 90.0, tail_stride: float = 4.0) -> Column:
    """Positions to look at, ascending: the first and last frame, one each stride, one each tail_stride of the last tail seconds, and
    the proposals in range; a null or empty recording has none."""
    seconds = frames / F.lit(fps)

    def cadence(start: Column, step: float) -> Column:
        n = F.ceil((seconds - 1e-12 - start) / step).cast("int") - 1
        at = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n)), lambda k: F.least(frames - 1, F.floor((start + k * step) * fps + 0.5).cast("int")))
        return F.when(n >= 0, at).otherwise(F.array().cast("array<int>"))

    dense = cadence(F.greatest(F.lit(0.0), seconds - tail), tail_stride) if tail > 0 else F.array().cast("array<int>")
    mine = F.filter(F.coalesce(proposals, F.array().cast("array<int>")), lambda p: (p >= 0) & (p < frames))
    every = F.concat(F.array(F.lit(0), frames - 1), cadence(F.lit(0.0), stride), dense, mine)
    return F.when(frames > 0, F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<int>"))
