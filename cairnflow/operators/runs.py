"""Runs, gaps and neighbours of ordered rows, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: str | list[str], order: str | list[str]):
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*([order] if isinstance(order, str) else order))


def islands(rows: DataFrame, by: str | list[str], order: str | list[str], breaks: Column) -> DataFrame:
    """rows with the number of their island (from 0); breaks is true where a row starts a new one, given ``prev`` columns made by lag."""
    w = _w(by, order)
    return rows.withColumn("island", F.sum(F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(breaks.cast("int"), F.lit(0)))).over(w))


def gap_islands(rows: DataFrame, by: str, order: str, gap: float) -> DataFrame:
    """Islands of rows whose order values follow each other within gap."""
    return islands(rows, by, order, F.col(order) - F.lag(order).over(_w(by, order)) > gap)


def true_runs(rows: DataFrame, by: str, pos: str, flag: Column, gap: int = 1, least: int = 1) -> DataFrame:
    """by, first, last and n of the runs of rows with flag, over gaps of up to gap positions, with a length of at least least positions."""
    r = gap_islands(rows.where(flag), by, pos, gap)
    out = r.groupBy(by, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("last") - F.col("first") + 1 >= least).drop("island")


def longest_run(rows: DataFrame, by: str, pos: str, flag: Column) -> DataFrame:
    """by and the length of the longest run of consecutive rows with flag (0 where none has it)."""
    seq = rows.withColumn("_k", F.row_number().over(_w(by, pos)))
    runs = seq.where(flag).withColumn("_g", F.col("_k") - F.row_number().over(_w(by, pos))).groupBy(by, "_g").count()
    best = runs.groupBy(by).agg(F.max("count").alias("longest"))
    return rows.select(by).distinct().join(best, by, "left").select(by, F.coalesce("longest", F.lit(0)).alias("longest"))


def label_runs(rows: DataFrame, by: str, pos: str, label: str) -> DataFrame:
    """Runs of equal neighbours: by, label, first, last, n."""
    r = islands(rows, by, pos, ~F.col(label).eqNullSafe(F.lag(label).over(_w(by, pos))))
    return r.groupBy(by, "island", label).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))


def rolling_median(rows: DataFrame, by: str, pos: str, value: str, k: int) -> DataFrame:
    """Median of the value over k rows around each one, fewer at the ends."""
    h = k // 2
    return rows.withColumn("smooth", F.percentile(value, 0.5).over(_w(by, pos).rowsBetween(-h, h)))


def lookahead(rows: DataFrame, by: str, pos: str, value: str, n: int, hard: float) -> DataFrame:
    """Over each row and the n - 1 after it: hits of at least hard, mean and most."""
    w = _w(by, pos).rowsBetween(0, n - 1)
    return rows.withColumns({"hits": F.sum((F.col(value) >= hard).cast("int")).over(w), "mean_ahead": F.avg(value).over(w), "max_ahead": F.max(value).over(w)})


def sustained(rows: DataFrame, by: str, pos: str, value: str, n: int, hard: float, hits: int, max_gap: int) -> DataFrame:
    """True where the n rows from here hold at least hits rows of at least hard, none further from the next than max_gap."""
    w = _w(by, pos).rowsBetween(0, n - 1)
    at = F.filter(F.collect_list(F.when(F.col(value) >= hard, F.col(pos))).over(w), lambda x: x.isNotNull())  # n at most
    gaps = F.zip_with(F.slice(at, 1, F.greatest(F.lit(0), F.size(at) - 1)), F.slice(at, 2, F.greatest(F.lit(0), F.size(at) - 1)), lambda a, b: b - a)
    return rows.withColumn("sustained", (F.size(at) >= hits) & (F.coalesce(F.array_max(gaps), F.lit(0)) <= max_gap))


def bridge_gaps(rows: DataFrame, by: str, pos: str, value: str, hard: float, soft: float, max_gap: int) -> DataFrame:
    """Soft rows between two hard ones at most max_gap apart are lifted to 0.7 of the lower, within [hard + 0.02, 0.62]."""
    w = _w(by, pos)
    last = F.last(F.when(F.col(value) >= hard, F.struct(pos, value)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(F.when(F.col(value) >= hard, F.struct(pos, value)), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    r = rows.withColumns({"_l": last, "_n": nxt})
    gap = F.col(f"_n.{pos}") - F.col(f"_l.{pos}")
    lift = F.greatest(F.lit(hard + 0.02), F.least(F.lit(0.62), F.least(F.col(f"_l.{value}"), F.col(f"_n.{value}")) * 0.7))
    fits = (F.col(value) < soft) & (gap > 1) & (gap <= max_gap)
    return r.withColumn("bridged", F.when(F.coalesce(fits, F.lit(False)), lift).otherwise(F.col(value))).drop("_l", "_n")


def velocities(rows: DataFrame, by: str, t: str, x: str) -> DataFrame:
    """Change of x per unit of t from the row before; null for the first and where t stands still."""
    w = _w(by, t)
    dt = F.col(t) - F.lag(t).over(w)
    return rows.withColumn("velocity", F.when(dt > 0, (F.col(x) - F.lag(x).over(w)) / dt))


def resolve_duplicates(rows: DataFrame, by: str, pos: str, label: str, confidence: str, missing: str, uncertain: str) -> DataFrame:
    """One row a position: all missing, or all of one label: the most confident; labels that differ: uncertain with the least confidence."""
    usable = F.col(label) != missing
    g = rows.groupBy(by, pos).agg(F.count_if(usable).alias("_n"), F.count_distinct(F.when(usable, F.col(label))).alias("_k"), F.max(F.when(usable, F.col(confidence))).alias("_hi"), F.min(F.when(usable, F.col(confidence))).alias("_lo"), F.max(confidence).alias("_any"), F.max(F.when(usable, F.col(label))).alias("_label"))
    return g.select(by, pos, F.when(F.col("_n") == 0, missing).when(F.col("_k") == 1, F.col("_label")).otherwise(uncertain).alias(label), F.when(F.col("_n") == 0, F.col("_any")).when(F.col("_k") == 1, F.col("_hi")).otherwise(F.col("_lo")).alias(confidence))


def paragraphs(rows: DataFrame, by: str, s: str, e: str, text: str, gap: float = 2.0) -> DataFrame:
    """Texts joined while the pause to the row before is under gap."""
    r = islands(rows, by, [s, e], F.col(s) - F.lag(e).over(_w(by, [s, e])) >= gap)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(s, e, text))), lambda x: x[text])
    return r.groupBy(by, "island").agg(F.min(s).alias(s), F.max(e).alias(e), F.array_join(parts, " ").alias(text))


def word_times(rows: DataFrame, s: str, e: str, words: Column) -> DataFrame:
    """Each word with an even share of its row's time."""
    r = rows.withColumn("_w", words).withColumn("_n", F.size("_w")).select("*", F.posexplode("_w").alias("word_no", "word"))
    step = (F.col(e) - F.col(s)) / F.col("_n")
    return r.withColumns({"word_start": F.col(s) + F.col("word_no") * step, "word_end": F.when(F.col("word_no") + 1 == F.col("_n"), F.col(e)).otherwise(F.col(s) + (F.col("word_no") + 1) * step)}).drop("_w", "_n")


def last_of_kind(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """The row of each kind that is last in order."""
    return rows.groupBy(kind).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def split_clusters(rows: DataFrame, by: str, x: str, least_gap: float) -> DataFrame:
    """Two clusters of x split at the largest gap (the first of equals) if it is at least least_gap: sides' medians and the gap."""
    w = _w(by, x)
    g = rows.withColumn("_gap", F.lead(x).over(w) - F.col(x)).withColumn("_k", F.row_number().over(w))
    cut = g.groupBy(by).agg(F.max("_gap").alias("gap"), F.max_by("_k", F.struct(F.col("_gap"), -F.col("_k"))).alias("_cut"), F.count("*").alias("n"))
    j = g.join(cut, by)
    two = (F.col("n") >= 4) & (F.col("gap") >= least_gap)
    return j.groupBy(by).agg(F.first(F.when(two, 2).otherwise(1)).alias("clusters"), F.first("gap").alias("gap"), F.percentile(F.when(~two | (F.col("_k") <= F.col("_cut")), F.col(x)), 0.5).alias("left"), F.percentile(F.when(two & (F.col("_k") > F.col("_cut")), F.col(x)), 0.5).alias("right"))


def evenly_spaced(rows: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """count rows of each key, spread evenly from the first to the last; positions are rounded half to even."""
    w = _w(by, order)
    n = F.count("*").over(Window.partitionBy(by))
    r = rows.withColumns({"_k": F.row_number().over(w) - 1, "_n": n})
    if count == 1:
        return r.where("_k = 0").drop("_k", "_n")
    want = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(count - 1)).cast("int"))
    return r.where((F.col("_n") <= count) | F.array_contains(want, F.col("_k"))).drop("_k", "_n")


def pick_run(runs: DataFrame, by: str, total: str, prefer: str = "last") -> DataFrame:
    """The run of each key with the best score of length, place and confidence."""
    place = {"first": 1 - F.col("first") / F.col(total), "last": F.col("last") / F.col(total)}.get(prefer, F.lit(0.5))
    score = 0.20 * F.col("n") / F.col(total) + 0.55 * place + 0.25 * F.col("confidence")
    return runs.withColumn("score", score).groupBy(by).agg(F.max_by(F.struct("*"), F.struct(F.col("score"), -F.col("first"))).alias("r")).select("r.*")


def bridged(segments: DataFrame, by: str, order: str, kind: str, seconds: str, confidence: Column, outer: str, unknown: str = "UNKNOWN", least: float = 0.85, most: float = 60.0) -> DataFrame:
    """Unknown segments of at most so many seconds between two of kind outer become outer_INFERRED, where the whole recording's
    confidence reaches least and it has three segments."""
    w = Window.partitionBy(by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(by))
    between = (F.lag(kind).over(w) == outer) & (F.lead(kind).over(w) == outer)
    fits = (F.col(kind) == unknown) & between & (F.col(seconds) <= most) & (n >= 3) & (confidence >= least)
    return segments.withColumn("inferred", F.coalesce(fits, F.lit(False))).withColumn(kind, F.when(F.col("inferred"), f"{outer}_INFERRED").otherwise(F.col(kind)))
