"""Which work a reading is of: by its people, and by its title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .nearness import holding


def year_nearness(a: Column, b: Column) -> Column:
    """2 within a year, 1 within three, else 0, as for unknown ones."""
    d = F.abs(a - b)
    return F.when(d <= 1, 2).when(d <= 3, 1).otherwise(0)


def resolve(people: DataFrame, facts: DataFrame, principals: DataFrame, works: DataFrame, by: str, first: int = 10, least: int = 2) -> DataFrame:
    """The work of each reading: people (by, person), facts (by, year, director), principals (work, person, ordering), works (work, year, directors).

    Candidates share at least ``least`` people with the reading among a work's ``first`` principals.  The one with most goes first, then the one
    nearest in year, then one with a director, then the least work.  It is locked with three people, or with two and the director;
    verdict: CONFIRMED, CONFLICT, NOTHING READ (no director to hold against it), NO SOURCE.  Its directors come with it."""
    hits = principals.where(F.col("ordering") <= first).select("work", "person").join(people.select(by, "person").distinct(), "person")
    c = hits.groupBy(by, "work").agg(F.count_distinct("person").alias("overlap")).where(F.col("overlap") >= least)
    c = c.join(works.select("work", F.col("year").alias("_wy"), "directors"), "work").join(facts.select(by, F.col("year").alias("_y"), "director"), by, "left")
    c = c.withColumn("nearness", year_nearness(F.col("_y"), F.col("_wy"))).withColumn("led", (F.size(F.coalesce("directors", F.array().cast("array<string>"))) > 0).cast("int"))
    w = Window.partitionBy(by).orderBy(F.desc("overlap"), F.desc("nearness"), F.desc("led"), "work")
    best = c.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    same = F.coalesce(F.array_contains("directors", F.col("director")), F.lit(False))
    locked = (F.col("overlap") >= 3) | same
    verdict = F.when(~locked, "NO SOURCE").when(F.col("director").isNull(), "NOTHING READ").when(same, "CONFIRMED").when(F.col("led") == 1, "CONFLICT").otherwise("NO SOURCE")
    return best.select(by, "work", "overlap", "nearness", "directors", verdict.alias("verdict"))


# What a title search scores: the title itself, one within the other, its longest word; kinds of works; years apart.
EXACT, WITHIN, KEYWORD = 100, 40, 15
KINDS = {"movie": 10, "tvSeries": 8, "tvMiniSeries": 8}
YEARS = ((0, 50), (2, 25), (5, 8))
FAR_YEARS, FAR = 15, -15


def keyword(title: Column) -> Column:
    """A title's first longest word of four letters or more, or all of it."""
    long = F.filter(F.split(title, " "), lambda w: F.length(w) >= 4)
    return F.coalesce(F.get(F.array_sort(F.transform(long, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))["w"], F.lit(0)), title)


def _near_points(year: Column, asked: Column) -> Column:
    """What years apart score; null if either is unknown."""
    apart = F.abs(year - asked)
    near = F.when(apart > FAR_YEARS, FAR)
    for years, points in reversed(YEARS):
        near = F.when(apart <= years, points).otherwise(near)
    return near


def _kind_points(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, n) for k, n in KINDS.items()], F.lit(0))


def _first(rows: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def _each(q: DataFrame, f: DataFrame, by: str) -> DataFrame:
    """by, work and score over 0 of every candidate: for those that ask by several titles, of which the best of each part counts."""
    found = q.join(holding(q, f, "key", "form"), "key").join(f.select("form", "work"), "form").select(by, "title", "key", "_y", "work").distinct()
    c = found.join(f.select("work", F.col("form").alias("_f"), "year", "kind"), "work")
    fit = F.when(F.col("_f") == F.col("title"), EXACT).when(F.contains(F.col("_f"), F.col("title")) | F.contains(F.col("title"), F.col("_f")), WITHIN).when(F.contains(F.col("_f"), F.col("key")), KEYWORD).otherwise(0)
    s = c.groupBy(by, "work").agg((F.max(fit) + F.max(_kind_points(F.col("kind"))) + F.coalesce(F.max(_near_points(F.col("year"), F.col("_y"))), F.lit(0))).alias("score"))
    return s.where("score > 0")


def search_titles(asked: DataFrame, forms: DataFrame, by: str, most: int = 3) -> DataFrame:
    """by, work, score and rank of the works that titles (by, title, year: normalised) may mean: forms (work, form, year, kind) has a row for each title a work goes by.

    Candidates hold the title or its keyword in one of their forms; they score by how the forms fit, by kind and by years apart.  Works with a
    score over 0, the best first, then the least work.

    Works of one form, kind and years score alike with any title, so that only the least few of each such class are asked; equal titles of a
    year ask once.  A common keyword meets its works once for all titles that have it, as what they score at least; works that fit a title
    better come by the title itself, by forms that hold it and by forms within it, and the better of a work's scores counts."""
    q = asked.select(by, "title", F.col("year").alias("_y")).where("title <> ''").distinct().withColumn("key", keyword(F.col("title")))
    q = written(q.withColumn("_n", F.count("*").over(Window.partitionBy(by))), "titles")
    f = written(forms.where("form <> '' AND work IS NOT NULL").select("work", "form", "year", "kind").distinct(), "forms")
    alone = q.where("_n = 1").withColumn("ask", F.struct("title", "_y"))
    asks = written(alone.select("ask", "title", "_y", "key").distinct(), "asks")
    works = f.groupBy("work").agg(F.max(_kind_points(F.col("kind"))).alias("kp"), F.sort_array(F.collect_set("year")).alias("ys"))
    own = written(f.select("work", "form").distinct().join(works, "work"), "works")
    few = written(_first(own, ["form", "kp", "ys"], ["work"], most), "classes")
    texts = own.select("form").distinct()
    titles = asks.select("title", "key").distinct()
    inside = written(holding(titles.select(F.explode(F.array_distinct(F.array("title", "key"))).alias("n")), texts, "n", "form"), "holding")
    year = F.coalesce(F.array_max(F.transform("ys", lambda x: _near_points(x, F.col("_y")))), F.lit(0))
    score = lambda fit: (fit + F.col("kp") + year).cast("int").alias("score")
    row = ["ask", "work"]
    best = [F.desc("score"), "work"]

    # what holds the keyword
    held = written(_first(inside.select(F.col("n").alias("key"), "form").join(titles.select("key").distinct(), "key", "left_semi").join(few, "form").select("key", "work", "kp", "ys").distinct(), ["key", "kp", "ys"], ["work"], most), "held")
    least = _first(asks.select("key", "_y").distinct().join(held, "key").withColumn("score", score(F.lit(KEYWORD))), ["key", "_y"], best, most)
    keyed = asks.select("ask", "title", "key", F.struct("key", "_y").alias("k")).join(least.select(F.struct("key", "_y").alias("k"), "work", "score"), "k")
    keyed = keyed.select(*row, (F.col("score") + F.when(F.col("title") == F.col("key"), WITHIN - KEYWORD).otherwise(0)).alias("score"))
    # the title itself, and what holds it
    exact = asks.join(few.withColumnRenamed("form", "title"), "title").select(*row, score(F.lit(EXACT)))
    longer = inside.select(F.col("n").alias("title"), "form").where("form <> title")
    longer = _first(longer.join(titles.where("title <> key").select("title"), "title", "left_semi").join(few, "form").select("title", "work", "kp", "ys").distinct(), ["title", "kp", "ys"], ["work"], most)
    wide = asks.join(longer, "title").select(*row, score(F.lit(WITHIN)))
    # what the title holds, of works that hold the keyword in this form or another
    ends = F.sequence(F.lit(1), F.length("title"))
    parts = titles.where("title <> key").select("title", "key", F.explode(F.array_distinct(F.flatten(F.transform(ends, lambda i: F.transform(F.sequence(F.lit(1), F.length("title") - i + 1), lambda n: F.substring(F.col("title"), i, n)))))).alias("form"))
    parts = written(parts.where("form <> title").join(texts, "form", "left_semi"), "parts")
    here = F.contains(F.col("form"), F.col("key"))
    small = asks.join(parts.where(here).select("title", "form"), "title").join(few, "form").select(*row, score(F.lit(WITHIN)))
    asked_for = parts.where(~here).select("form", "key").distinct()
    both = own.join(asked_for.select("form").distinct(), "form", "left_semi").join(f.select("work", F.col("form").alias("other")).distinct(), "work").where("form <> other")
    both = _first(both, ["form", "other", "kp", "ys"], ["work"], most)
    other = inside.select(F.col("n").alias("key"), F.col("form").alias("other")).join(both, "other").join(asked_for, ["form", "key"], "left_semi")
    other = written(_first(other.select("form", "key", "work", "kp", "ys").distinct(), ["form", "key", "kp", "ys"], ["work"], most), "others")
    apart = asks.join(parts.where(~here), ["title", "key"]).join(other, ["form", "key"]).select(*row, score(F.lit(WITHIN)))

    scores = keyed
    for more in (exact, wide, small, apart):
        scores = scores.unionByName(_first(more.distinct(), ["ask"], best, most))
    scores = scores.where("score > 0").groupBy(*row).agg(F.max("score").alias("score"))
    s = alone.select(by, "ask").join(_first(scores, ["ask"], best, most), "ask").select(by, "work", "score")
    s = s.unionByName(_each(q.where("_n > 1"), f, by))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "work"))).where(F.col("rank") <= most)
