"""Works found by their people and by their titles, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import identity
from ..sources.shared import written
from .relational import read


@query("""
WITH p AS (SELECT l_orderkey AS work, l_suppkey AS person, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordering FROM lineitem),
w AS (SELECT o_orderkey AS work, year(o_orderdate) AS year, CASE WHEN o_orderkey % 4 = 0 THEN [] WHEN o_orderkey % 6 = 1 THEN ['d' || o_custkey % 9, 'd' || o_orderkey % 9] ELSE ['d' || o_custkey % 9] END AS directors FROM orders),
a AS (SELECT s_suppkey AS person, s_nationkey AS reading FROM supplier),
f AS (SELECT n_nationkey AS reading, 1992 + n_nationkey % 7 AS year, CASE WHEN n_nationkey % 5 <> 0 THEN 'd' || n_nationkey % 9 END AS director FROM nation),
c AS (SELECT reading, work, count(DISTINCT person) AS overlap FROM p JOIN a USING (person) WHERE ordering <= 6 GROUP BY 1, 2 HAVING count(DISTINCT person) >= 2),
r AS (SELECT c.*, w.directors, director, CASE WHEN abs(w.year - f.year) <= 1 THEN 2 WHEN abs(w.year - f.year) <= 3 THEN 1 ELSE 0 END AS nearness, len(w.directors) > 0 AS led, coalesce(list_contains(w.directors, director), false) AS same
      FROM c JOIN w USING (work) LEFT JOIN f USING (reading))
SELECT reading, work, overlap, nearness, array_to_string(directors, ',') AS directors,
       CASE WHEN overlap < 3 AND NOT same THEN 'NO SOURCE' WHEN director IS NULL THEN 'NOTHING READ' WHEN same THEN 'CONFIRMED' WHEN led THEN 'CONFLICT' ELSE 'NO SOURCE' END AS verdict
FROM r QUALIFY row_number() OVER (PARTITION BY reading ORDER BY overlap DESC, nearness DESC, led DESC, work) = 1""")
def work_by_people(spark: SparkSession, d: str) -> DataFrame:
    """The work that most of a reading's people share among its first principals, then by year and director; its verdict."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    principals = l.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("person"), order.alias("ordering"))
    name = lambda c: F.concat(F.lit("d"), F.col(c) % 9)
    led = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 6 == 1, F.array(name("o_custkey"), name("o_orderkey"))).otherwise(F.array(name("o_custkey")))
    works = read(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").alias("year"), led.alias("directors"))
    people = read(spark, d, "supplier").select(F.col("s_nationkey").alias("reading"), F.col("s_suppkey").alias("person"))
    facts = read(spark, d, "nation").select(F.col("n_nationkey").alias("reading"), (F.lit(1992) + F.col("n_nationkey") % 7).alias("year"), F.when(F.col("n_nationkey") % 5 != 0, name("n_nationkey")).alias("director"))
    got = identity.resolve(people, facts, principals, works, "reading", 6, 2)
    return got.withColumn("directors", F.array_join("directors", ","))


_FORMS = """SELECT doc_id AS work, lower(array_to_string(w[1:2], ' ')) AS form, 1950 + doc_id % 70 AS year, ['movie', 'tvSeries', 'short', 'tvMiniSeries'][doc_id % 4 + 1] AS kind, w FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM documents) WHERE len(w) >= 2"""


@query(f"""
WITH b AS ({_FORMS}), f AS (SELECT work, form, year, kind FROM b UNION ALL SELECT work, lower(w[2]), year, kind FROM b WHERE work % 3 = 0),
q AS (SELECT work AS asked, lower(array_to_string(w[CASE WHEN work % 2 = 0 THEN 1 ELSE 2 END:2], ' ')) AS title, year + work // 100 % 8 AS year FROM b WHERE work % 100 = 0 OR work % 100 = 1),
k AS (SELECT *, coalesce(list_filter(string_split(title, ' '), lambda x: length(x) >= 4 AND length(x) = list_max(list_transform(string_split(title, ' '), lambda y: length(y))))[1], title) AS key FROM q),
c AS (SELECT DISTINCT asked, title, key, k.year AS y, work FROM k JOIN f ON contains(form, key)),
s AS (SELECT asked, work, max(CASE WHEN form = title THEN 100 WHEN contains(form, title) OR contains(title, form) THEN 40 WHEN contains(form, key) THEN 15 ELSE 0 END)
             + max(CASE kind WHEN 'movie' THEN 10 WHEN 'tvSeries' THEN 8 WHEN 'tvMiniSeries' THEN 8 ELSE 0 END)
             + max(CASE WHEN abs(year - y) = 0 THEN 50 WHEN abs(year - y) <= 2 THEN 25 WHEN abs(year - y) <= 5 THEN 8 WHEN abs(year - y) > 15 THEN -15 ELSE 0 END) AS score FROM c JOIN f USING (work) GROUP BY 1, 2)
SELECT asked, work, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, work) AS rank FROM s WHERE score > 0 QUALIFY rank <= 3""")
def work_by_title(spark: SparkSession, d: str) -> DataFrame:
    """The three works that a title may mean, by how their forms fit, their kinds and years; asked by documents whose id ends in 00 or 01."""
    # texts are read and cut in words once
    b = written(read(spark, d, "documents").select("doc_id", F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})")), 1, 2).alias("w")), "words").where("size(w) >= 2")
    kind = F.get(F.array(*map(F.lit, ("movie", "tvSeries", "short", "tvMiniSeries"))), (F.col("doc_id") % 4).cast("int"))
    both = F.lower(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))))
    own = b.select(F.col("doc_id").alias("work"), both.alias("form"), (F.lit(1950) + F.col("doc_id") % 70).alias("year"), kind.alias("kind"), F.lower(F.get("w", F.lit(1))).alias("second"))
    forms = own.drop("second").unionByName(own.where("work % 3 = 0").select("work", F.col("second").alias("form"), "year", "kind"))
    asked = own.where("work % 100 IN (0, 1)").select(F.col("work").alias("asked"), F.when(F.col("work") % 2 == 0, F.col("form")).otherwise(F.col("second")).alias("title"), (F.col("year") + F.floor(F.col("work") / 100) % 8).alias("year"))
    return identity.search_titles(asked, forms, "asked")
