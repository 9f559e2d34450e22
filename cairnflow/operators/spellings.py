"""Spellings of names put together, over whole tables: candidates by the indexes of ``nearness``, decisions by the rounds of ``rounds``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import TITLES
from ..functions.text import ascii_fold, tokens
from ..sources.shared import written
from . import graphs, nearness, rounds


def untitled(name: str) -> Column:
    """A name without leading academic titles, if two words are left."""
    words = F.split(F.trim(F.col(name)), r"\s+")
    title = lambda w: F.coalesce(F.forall(F.filter(F.split(w, r"\."), lambda p: p != ""), lambda p: ascii_fold(p).isin(*sorted(TITLES))) & w.rlike("[^.]"), F.lit(False))
    at = F.array_position(F.transform(words, lambda w: ~title(w)), True)  # the first that is no title
    rest = F.slice(words, F.greatest(F.lit(1), at.cast("int")), F.size(words))
    return F.when((at > 1) & (F.size(rest) >= 2), F.array_join(rest, " ")).otherwise(F.trim(F.col(name)))


def clusters(rows: DataFrame, by: str, mark: str, text: str, pos: str) -> DataFrame:
    """by, text, cluster and n (marks that it has been met under) of each spelling: those that may be one person's, without titles, are together unless they were
    met under one mark (an episode); see ``rounds.vetoed_clusters``."""
    r = rows.select(F.col(by).alias("by"), F.trim(F.col(text)).alias("item"), F.col(mark).alias("mark"), F.col(pos).alias("pos")).where("item <> ''")
    items = written(r.select("by", "item").distinct().withColumn("bare", untitled("item")), "spellings")
    near = nearness.near_names(items, "bare", "by")
    same = items.select("by", "bare").distinct().where(F.size(tokens(ascii_fold(F.col("bare")), 3)) > 0).select("by", F.col("bare").alias("a"), F.col("bare").alias("b"))
    ends = [items.select("by", F.col("item").alias(f"i{c}"), F.col("bare").alias(c)) for c in "ab"]
    pairs = near.unionByName(same).join(ends[0], ["by", "a"]).join(ends[1], ["by", "b"]).where("ia <> ib").select("by", F.col("ia").alias("a"), F.col("ib").alias("b"))
    found = rounds.vetoed_clusters(r, written(pairs, "near"))
    n = r.groupBy("by", "item").agg(F.count_distinct("mark").cast("int").alias("n"))
    return found.join(n, ["by", "item"]).select(F.col("by").alias(by), F.col("item").alias(text), "cluster", "n")


def matching_scores(rows: DataFrame, by: str, side: str, text: str, least: float) -> DataFrame:
    """Precision and recall of candidates (side c) against the truth (t): distinct texts, matched one to one by falling sequence ratio."""
    r = rows.select(F.col(by).alias("by"), F.col(side).alias("side"), F.col(text).alias("text")).distinct()
    c, t = (r.where(F.col("side") == s).select("by", "text") for s in "ct")
    pairs = nearness.similar_texts(c, t, "text", least, "by")
    hits = rounds.matched(pairs, ["by", "l"], ["by", "r"], ["ratio"]).groupBy("by").agg(F.count("*").alias("n"))
    sides = r.groupBy("by").agg(F.count_if(F.col("side") == "c").alias("c"), F.count_if(F.col("side") == "t").alias("t"))
    j = sides.join(hits, "by", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, q = share(F.col("n"), F.col("c")), share(F.col("n"), F.col("t"))
    return j.select(F.col("by").alias(by), F.col("n").cast("int").alias("tp"), (F.col("c") - F.col("n")).cast("int").alias("fp"), (F.col("t") - F.col("n")).cast("int").alias("fn"), F.bround(p, 4).alias("precision"), F.bround(q, 4).alias("recall"), F.bround(share(2 * p * q, p + q), 4).alias("f1"))


def fuzzy_clusters(rows: DataFrame, by: str, row: str, text: str, confidence: str, least: float, length: float = 0.6) -> DataFrame:
    """by, row and text of each chain of near texts, as its most confident row (the first of equals), without those that are most of a
    longer one.  Equal texts of a key are one node; a pair counts if a row of the first comes before one of the second."""
    r = rows.select(F.col(by).alias("by"), F.col(row).alias("row"), F.col(text).alias("text"), F.col(confidence).alias("confidence"))
    texts = written(r.groupBy("by", "text").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.max_by(F.struct("row", "confidence"), F.struct("confidence", -F.col("row"))).alias("best")), "texts")
    pairs = nearness.similar_texts(texts, texts, "text", least, "by").where("l <> r")
    ends = [texts.select("by", F.col("text").alias(c), F.col(f).alias(f)) for c, f in (("l", "lo"), ("r", "hi"))]
    m, n = F.length("l"), F.length("r")
    pairs = pairs.join(ends[0], ["by", "l"]).join(ends[1], ["by", "r"]).where((F.col("lo") < F.col("hi")) & (F.least(m, n) >= length * F.greatest(m, n)))
    node = lambda c: F.struct("by", F.col(c).alias("t"))
    comp = graphs.components(pairs.select(node("l").alias("a"), node("r").alias("b"))).select("node.by", F.col("node.t").alias("text"), F.col("component.t").alias("c"))
    best = texts.join(comp, ["by", "text"], "left").groupBy("by", F.coalesce("c", "text").alias("c")).agg(F.max_by(F.struct("best.row", "text"), F.struct("best.confidence", -F.col("best.row"))).alias("b")).select("by", "b.row", "b.text")
    best = written(best, "best")
    # one text stands in another only if its rarest bigram does
    n = F.length("text")
    grams = best.select("by", "text", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring("text", i, F.lit(2)))).alias("g")).distinct()
    rare = grams.join(grams.groupBy("by", "g").agg(F.count("*").alias("df")), ["by", "g"]).groupBy("by", "text").agg(F.min_by("g", F.struct("df", "g")).alias("g")).where("length(text) >= 3")
    inside = rare.join(grams.withColumnRenamed("text", "longer"), ["by", "g"]).where((F.length("text") < F.length("longer")) & (F.length("text") >= length * F.length("longer")) & F.contains(F.col("longer"), F.col("text")))
    return best.join(inside.select("by", "text").distinct(), ["by", "text"], "left_anti").select(F.col("by").alias(by), F.col("row").alias(row), F.col("text").alias(text))


def clone_collapse(rows: DataFrame, by: str, row: str, text: str, evidence: str, known: str, least: float) -> DataFrame:
    """by, row and text without clones: of two near names of as many tokens the one without evidence goes; of two with evidence, neither known,
    the weaker one, or the later of equals.  Pairs are taken in the order of their rows, and one whose end is gone isn't."""
    r = written(rows.select(F.col(by).alias("by"), F.col(row).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(evidence), F.lit(0)).alias("e"), F.col(known).alias("known")), "names")
    texts = r.select("by", "text").distinct()
    size = lambda c: F.size(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != ""))
    near = nearness.similar_texts(texts, texts, "text", least, "by").where(size("l") == size("r"))
    ends = [r.select("by", F.col("row").alias(c), F.col("text").alias(t), F.col("e").alias(f"e{c}"), F.col("known").alias(f"k{c}")) for c, t in (("a", "l"), ("b", "r"))]
    pairs = near.join(ends[0], ["by", "l"]).join(ends[1], ["by", "r"]).where("a < b")
    one = (F.col("ea") != 0) != (F.col("eb") != 0)
    loser = F.when(one, F.when(F.col("ea") != 0, F.col("b")).otherwise(F.col("a"))).when((F.col("ea") != 0) & ~F.col("ka") & ~F.col("kb"), F.when(F.col("ea") >= F.col("eb"), F.col("b")).otherwise(F.col("a")))
    left = rounds.survivors(r.select("by", F.col("row").alias("node")), pairs.select("by", "a", "b", loser.alias("loser")))
    return r.join(left.withColumnRenamed("node", "row"), ["by", "row"], "left_semi").select(F.col("by").alias(by), F.col("row").alias(row), F.col("text").alias(text))


def _ordered(rows: DataFrame, by: str, text: str, n: str) -> DataFrame:
    """by, text, n and node: the place in order of falling n, then text."""
    return written(rows.select(F.col(by).alias("by"), F.col(text).alias("text"), F.col(n).alias("n"), F.struct((-F.col(n)).alias("o"), F.col(text).alias("t")).alias("node")), "spellings")


def _pairs(r: DataFrame, near: DataFrame) -> DataFrame:
    """near (by, l, r of texts) as pairs of nodes, the earlier first; l is the text of the row that ``near`` takes first."""
    ends = [r.select("by", F.col("text").alias(t), F.col("node").alias(c)) for c, t in (("x", "l"), ("y", "r"))]
    return near.join(ends[0], ["by", "l"]).join(ends[1], ["by", "r"])


def spelling_groups(rows: DataFrame, by: str, text: str, n: str, least: float = 0.86) -> DataFrame:
    """by, text, n and members of groups of near spellings (by, text distinct, n): by falling n each joins the first group that has a member near it: as many
    words, the first one equal, and a ratio of at least so much, all folded.  Of a group the spelling with most marks, then n, then
    length, stands for all, with the sum of their counts."""
    r = _ordered(rows, by, text, n).withColumn("fold", F.trim(F.regexp_replace(ascii_fold("text"), " +", " ")))
    folds = r.where("fold <> ''").select("by", F.col("fold").alias("t")).distinct()
    near = nearness.similar_texts(folds, folds, "t", least, "by")
    words = lambda c: F.split(F.col(c), " ")
    near = near.where((F.size(words("l")) == F.size(words("r"))) & (words("l")[0] == words("r")[0]))
    pairs = _pairs(r.withColumn("text", F.col("fold")), near).where("x < y").select("by", F.col("x").alias("a"), F.col("y").alias("b"))
    g = rounds.first_groups(r.select("by", "node"), pairs)
    marks = F.length(F.regexp_replace("text", r"[^\p{L}]|[\x00-\x7F]", ""))
    d = r.join(g, ["by", "node"]).groupBy("by", "group").agg(F.min_by("text", F.struct(-marks, -F.col("n"), -F.length("text"), F.col("node"))).alias("text"), F.sum("n").alias("n"), F.count("*").cast("int").alias("members"))
    return d.select(F.col("by").alias(by), F.col("text").alias(text), "n", "members")


def variant_merge(rows: DataFrame, by: str, text: str, n: str, least: float) -> DataFrame:
    """by, text and n of spellings (by, text distinct, n) after each has joined, by falling n, the first kept one of as many tokens that it is near."""
    r = _ordered(rows, by, text, n)
    near = nearness.similar_texts(r, r, "text", least, "by")
    size = lambda c: F.size(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != ""))
    pairs = _pairs(r, near.where(size("l") == size("r"))).where("y < x").select("by", F.col("y").alias("a"), F.col("x").alias("b"))
    led = rounds.leaders(r.select("by", "node"), pairs)
    return r.join(led, ["by", "node"]).groupBy("by", F.col("leader.t").alias("text")).agg(F.sum("n").alias("n")).select(F.col("by").alias(by), F.col("text").alias(text), "n")
