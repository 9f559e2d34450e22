"""Lookups, ranked and fuzzy joins of names and titles."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import ascii_fold, tokens
from .nearness import holding


def keys_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among keys; Spark broadcasts keys only if they are small."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def add_missing(primary: DataFrame, fallback: DataFrame, key: Column) -> DataFrame:
    """primary, and those rows of fallback whose key it lacks."""
    k = primary.select(key.alias("_k")).distinct()
    extra = fallback.withColumn("_k", key).join(k, "_k", "left_anti").drop("_k")
    return primary.unionByName(extra, allowMissingColumns=True)


def deref(rows: DataFrame, row_id: str, ids: Column, table: DataFrame, key: str, label: Column, keep_raw: bool = False) -> DataFrame:
    """The labels of a row's list of ids in the list's order; unknown ids are dropped, or kept as they are."""
    r = rows.select(row_id, F.posexplode(ids).alias("_p", "_id"))
    j = r.join(table.select(F.col(key).alias("_id"), label.alias("_l")), "_id", "left")
    value = F.coalesce("_l", "_id") if keep_raw else F.col("_l")
    got = F.transform(F.filter(F.sort_array(F.collect_list(F.struct(F.col("_p"), value.alias("v")))), lambda x: x["v"].isNotNull()), lambda x: x["v"])
    return j.groupBy(row_id).agg(got.alias("labels"))


def two_pass(queries: DataFrame, table: DataFrame, needle: str, name: str, key: str) -> DataFrame:
    """Rows of table whose folded name equals a query's, else holds it; each key once a query, by its best pass.  The first pass is a hash
    join; the second goes by the rarest grams of the needles, over distinct names."""
    q = queries.withColumn("_q", ascii_fold(F.col(needle))).where("_q != ''")
    t = table.withColumn("_t", ascii_fold(F.col(name)))
    exact = q.join(t, F.col("_q") == F.col("_t")).withColumn("pass", F.lit(1))
    part = q.join(holding(q, t, "_q", "_t"), "_q").join(t, "_t").withColumn("pass", F.lit(2))
    both = exact.unionByName(part).drop("_q", "_t")
    w = Window.partitionBy(needle, key).orderBy("pass")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deletions(c: Column) -> Column:
    """A string and all strings with one character less: two strings within one edit share one of them."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, n)))
    return F.array_distinct(F.when(n > 0, F.concat(F.array(c), cut)).otherwise(F.array(c)))


def one_edit_join(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs within one edit, by equality of deletion neighbourhoods and a check."""
    x = a.select(left, F.explode(deletions(F.col(left))).alias("_k"))
    y = b.select(right, F.explode(deletions(F.col(right))).alias("_k"))
    return x.join(y, "_k").select(left, right).distinct().withColumn("edits", F.levenshtein(left, right)).where("edits <= 1")


def blocked_similar(a: DataFrame, b: DataFrame, left: str, right: str, least: float = 0.9, margin: float = 0.03, length: int = 3) -> DataFrame:
    """For each left name the right one with the best Jaro-Winkler similarity, if it beats the next by margin; candidates share the
    first letter and a length within 3."""
    x = a.select(left).distinct().withColumn("_f", F.left(left, F.lit(1))).withColumn("_n", F.explode(F.sequence(F.length(left) - length, F.length(left) + length)))
    y = b.select(right).distinct().withColumn("_f", F.left(right, F.lit(1))).withColumn("_n", F.length(right))
    s = x.join(y, ["_f", "_n"]).withColumn("score", similarity.jaro_winkler(left, right)).where(F.col("score") >= least)
    w = Window.partitionBy(left).orderBy(F.desc("score"), right)
    r = s.withColumns({"_r": F.row_number().over(w), "_next": F.lead("score").over(w)})
    return r.where((F.col("_r") == 1) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))).select(left, right, "score")


def unique_containment(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Names whose longest token is in just one right name that also fits their initials."""
    x = a.select(left).withColumn("_t", tokens(ascii_fold(F.col(left)))).withColumn("_k", F.element_at(F.array_sort("_t", lambda p, q: F.length(q) - F.length(p)), 1))
    y = b.select(right).withColumn("_u", tokens(ascii_fold(F.col(right)))).withColumn("_k", F.explode("_u"))
    fits = F.forall("_t", lambda t: F.exists("_u", lambda u: F.when(F.length(t) == 1, F.left(u, F.lit(1)) == t).otherwise(u == t)))
    return x.join(y, "_k").where(fits).groupBy(left).agg(F.count_distinct(right).alias("n"), F.min(right).alias(right)).where("n = 1").drop("n")


def shared_members(pairs: DataFrame, group: str, member: str, wanted: DataFrame, least: int, k: int) -> DataFrame:
    """The k groups with most distinct members among wanted, with at least least; ties by group."""
    hits = pairs.join(wanted.select(member).distinct(), member, "left_semi")
    return hits.groupBy(group).agg(F.count_distinct(member).alias("shared")).where(F.col("shared") >= least).orderBy(F.desc("shared"), group).limit(k)


def vote_identity(votes: DataFrame, by: str, candidate: str, voter: str, director: Column, year: Column, max_year: Column) -> DataFrame:
    """The candidate with most distinct voters (+3 for the director's), none over two years past max_year: certain with three votes, or
    two and the director, unless the runner-up has three and at most one less."""
    v = votes.where(max_year.isNull() | year.isNull() | (year <= max_year + 2)).groupBy(by, candidate).agg(F.count_distinct(voter).alias("votes"), F.max(director).alias("dir"))
    w = Window.partitionBy(by).orderBy(F.desc(F.col("votes") + F.when(F.col("dir"), 3).otherwise(0)), F.desc("votes"), F.desc(candidate))
    r = v.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("votes").over(w), F.lit(0))}).where("_r = 1")
    gate = (F.col("votes") >= 3) | (F.col("dir") & (F.col("votes") >= 2))
    unclear = (F.col("_next") >= 3) & (F.col("_next") >= F.col("votes") - 1)
    return r.select(by, candidate, "votes", F.col("dir").alias("director_match"), unclear.alias("ambiguous"), F.when(gate & ~unclear, "CERTAIN").otherwise("REVIEW").alias("status"))


def route(rows: DataFrame, routes: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with the value of their key's route, of the route '*', or default."""
    star = routes.where(F.col(key) == "*").agg(F.first(value).alias("_star"))
    j = rows.join(routes.where(F.col(key) != "*").select(key, value), key, "left").join(F.broadcast(star))  # one row
    return j.withColumn(value, F.coalesce(value, "_star", F.lit(default))).drop("_star")


def nearest_value(rows: DataFrame, table: DataFrame, by: str, row_id: str, x: str, y: str, reach: float) -> DataFrame:
    """Each row with table's row of its key whose y is nearest to x, within reach; the smaller y of equals.  Values in reach are at
    most one bucket of that width apart, so buckets make the candidates and a hot key is dealt by value."""
    bucket = lambda c: F.floor(c / reach).cast("long")
    t = table.groupBy(by, y).agg(F.lit(1).alias("_one")).select(by, y, F.explode(F.array(*[bucket(F.col(y)) + k for k in (-1, 0, 1)])).alias("_b"))
    j = rows.select(by, row_id, x, bucket(F.col(x)).alias("_b")).join(t, [by, "_b"]).where(F.abs(F.col(x) - F.col(y)) <= reach)
    return j.groupBy(row_id).agg(F.min_by(y, F.struct(F.abs(F.col(x) - F.col(y)), F.col(y))).alias(y))


def fused_lines(lines: DataFrame, by: str, y: str, tolerance: float) -> DataFrame:
    """Left and right texts of one line (y within tolerance) that are nearest to each other; all others keep a null side.  See
    ``line_partners`` for a partner for each row that can have one."""
    # of the rows of one side at one y the first is nearer, by row, to whatever the others are near: no other can have a mutual partner
    first = lines.groupBy(by, "side", y).agg(F.min(F.struct("row", "text")).alias("_f")).select(by, "side", y, "_f.row", "_f.text")
    rows = first.withColumn("_b", F.explode(F.array(F.floor(F.col(y) / tolerance), F.floor(F.col(y) / tolerance) + 1)))
    a, b = (rows.where(F.col("side") == s).select(by, "_b", F.col(y).alias(f"y{s}"), F.col("text").alias(s), F.col("row").alias(f"r{s}")) for s in "lr")
    p = a.join(b, [by, "_b"]).where(F.abs(F.col("yl") - F.col("yr")) <= tolerance).drop("_b").distinct()
    # mutual nearest partners
    p = p.withColumn("_d", F.abs(F.col("yl") - F.col("yr")))
    wl, wr = Window.partitionBy(by, "rl").orderBy("_d", "rr"), Window.partitionBy(by, "rr").orderBy("_d", "rl")
    m = p.withColumns({"_a": F.row_number().over(wl), "_c": F.row_number().over(wr)}).where("_a = 1 and _c = 1").select(by, "rl", "rr", "l", "r")
    alone = lines.select(by, "row", "side", "text")
    left = alone.where("side = 'l'").join(m.select(by, F.col("rl").alias("row")), [by, "row"], "left_anti").select(by, F.col("text").alias("l"), F.lit(None).cast("string").alias("r"))
    right = alone.where("side = 'r'").join(m.select(by, F.col("rr").alias("row")), [by, "row"], "left_anti").select(by, F.lit(None).cast("string").alias("l"), F.col("text").alias("r"))
    return m.select(by, "l", "r").unionByName(left).unionByName(right)


def _partners(tolerance: float):
    """Of rows (by, island, y, side, text) in order: the oldest that waits takes the first of the other side within tolerance.  All that wait are
    of one side, so what is held is the rows of that side within tolerance."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting = None, deque()
        alone = lambda by, side, text: (by, text, None) if side == "l" else (by, None, text)
        for pdf in parts:
            out = []
            for by, island, y, side, text in zip(*(pdf[c].tolist() for c in ("by", "island", "y", "side", "text"))):
                while waiting and ((by, island) != now or y - waiting[0][0] > tolerance):
                    out.append(alone(now[0], *waiting.popleft()[1:]))
                now = (by, island)
                if waiting and waiting[0][1] != side:
                    other = waiting.popleft()[2]
                    out.append((by, text, other) if side == "l" else (by, other, text))
                else:
                    waiting.append((y, side, text))
            if out:
                yield pd.DataFrame(out, columns=["by", "l", "r"], dtype=object)
        if waiting:
            yield pd.DataFrame([alone(now[0], *w[1:]) for w in waiting], columns=["by", "l", "r"], dtype=object)

    return run


def line_partners(lines: DataFrame, by: str, y: str, tolerance: float) -> DataFrame:
    """Left and right texts of one line: in order of y, then row, each takes the first later one of the other side within tolerance that is
    still free; those left without keep a null side.  Rows behind a gap wider than tolerance are dealt apart."""
    r = lines.where("side IN ('l', 'r')").select(F.col(by).alias("by"), F.col(y).cast("double").alias("y"), "row", "side", "text")
    placed = F.col("by").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y")
    w = Window.partitionBy("by").orderBy("y", "row")
    far = F.coalesce((F.col("y") - F.lag("y").over(w) > tolerance).cast("int"), F.lit(0))
    d = r.where(placed).withColumn("_far", far).withColumn("island", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.select("by", "island", "y", "row", "side", "text").repartition(tasks, "by", "island").sortWithinPartitions("by", "island", "y", "row")
    met = d.mapInPandas(_partners(tolerance), f"by {r.schema['by'].dataType.simpleString()}, l string, r string")
    lone = r.where(~F.coalesce(placed, F.lit(False))).select("by", F.when(F.col("side") == "l", F.col("text")).alias("l"), F.when(F.col("side") == "r", F.col("text")).alias("r"))
    return met.unionByName(lone).withColumnRenamed("by", by)


def either_key(rows: DataFrame, table: DataFrame, key: Column, first: Column, second: Column, table_id: str) -> DataFrame:
    """Rows with the table's rows one of whose two keys equals theirs: two hash joins rather than one on a disjunction."""
    r = rows.withColumn("_k", key).where("_k != ''")
    a, b = (r.join(table.withColumn("_k", c), "_k") for c in (first, second))
    return a.unionByName(b).dropDuplicates([*rows.columns, table_id]).drop("_k")


def has_member(rows: DataFrame, list_column: str, sep: str, wanted: DataFrame, member: str) -> DataFrame:
    """Rows whose delimited list holds one of wanted, as a whole member."""
    e = rows.select("*", F.explode(F.array_distinct(F.split(list_column, sep))).alias("_m"))
    return e.join(wanted.select(F.col(member).alias("_m")).distinct(), "_m", "left_semi").drop("_m").distinct()


def best_left_partner(names: DataFrame, roles: DataFrame, by: str, seconds: float, height: float, width: float) -> DataFrame:
    """The role (by, role_id, t, x, y) nearest to each name (by, name_id, t, x, y) among those left of it, in reach in time and height;
    buckets of time make the candidates."""
    a = names.select(by, "name_id", F.col("t").alias("nt"), F.col("x").alias("nx"), F.col("y").alias("ny")).withColumn("_b", F.explode(F.array(F.floor(F.col("nt") / seconds) - 1, F.floor(F.col("nt") / seconds), F.floor(F.col("nt") / seconds) + 1)))
    b = roles.select(by, "role_id", F.col("t").alias("rt"), F.col("x").alias("rx"), F.col("y").alias("ry")).withColumn("_b", F.floor(F.col("rt") / seconds))
    dt, dy, dx = F.abs(F.col("nt") - F.col("rt")), F.abs(F.col("ny") - F.col("ry")), F.col("nx") - F.col("rx")
    j = a.join(b, [by, "_b"]).where((dt <= seconds) & (dy <= height) & (dx > 0) & (dx <= width))
    score = 1 - 0.5 * dy / height - 0.3 * dt / seconds - 0.2 * dx / width
    return j.groupBy(by, "name_id").agg(F.max_by(F.struct("role_id", score.alias("score")), F.struct(score, -F.col("role_id"))).alias("m")).select(by, "name_id", "m.*")


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of two sources with one number; they must be as many."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} and {b} rows")
    return left.join(right, order)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed whatever the partitions, in order of key: those of the least digests of key
    and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key).limit(n).orderBy(key)


def reconciled(rows: DataFrame, other: DataFrame, key: str, role: str, other_role: str) -> DataFrame:
    """rows (key, role) with a second source's role where that has one: ``how`` is own without one, kept where both agree, moved else."""
    j = rows.join(other.select(key, other_role), key, "left")
    how = F.when(F.col(other_role).isNull(), "own").when(F.col(other_role) == F.col(role), "kept").otherwise("moved")
    return j.withColumn("how", how).withColumn(role, F.coalesce(other_role, role)).drop(other_role)


def dubbed(foreign: Column, native: Column) -> Column:
    """Whether a name on a work of foreign origin is a native's, as dubbing casts are; unknown origins and hands are not."""
    return F.coalesce(foreign & native, F.lit(False))
