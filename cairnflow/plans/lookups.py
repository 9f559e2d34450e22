"""Knowledge-base lookups, pairings and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import similarity as S
from ..functions import text as T
from ..operators import spellings
from ..operators import relational as R
from ..sources import files
from .ordered import frames
from .relational import read, spread
from .textual import turns_before

SCHEMAS = {"part": "p_partkey long, p_name string, p_brand string, p_size int", "missing_table": "k long"}


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 45 AND p_brand <> 'Brand#11'")
def parameterised_sql(spark: SparkSession, d: str) -> DataFrame:
    """Named views of a folder's tables (a missing one is empty) and SQL with parameters."""
    files.tables(spark, d, SCHEMAS)
    return spark.sql("SELECT p_partkey, p_name FROM part WHERE p_size >= :least AND p_brand <> :brand AND p_partkey NOT IN (SELECT k FROM missing_table)", args={"least": 45, "brand": "Brand#11"})


@query("SELECT p_partkey FROM part ORDER BY md5(concat_ws(':', p_partkey, 7)), p_partkey LIMIT 100")
def seeded_rows(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of the whole table."""
    return R.seeded_sample(read(spark, d, "part").select("p_partkey"), "p_partkey", 100, 7)


@query("SELECT p_partkey, p_name, upper(p_name) AS other FROM part")
def zipped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two sources with one number, which must be as many."""
    p = read(spark, d, "part")
    return R.zipped(p.select("p_partkey", "p_name"), p.select("p_partkey", F.upper("p_name").alias("other")), "p_partkey")


@query("""
WITH n AS (SELECT n_nationkey, lower(n_name) AS k FROM nation), s AS (SELECT s_suppkey, lower(s_name) AS a, lower(n_name) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_nationkey, s_suppkey FROM n JOIN s ON k = a OR k = b""")
def either_key(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by either of two folded keys, as a union of equality joins."""
    n = read(spark, d, "nation")
    s = read(spark, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("b")), "s_nationkey").select("s_suppkey", F.lower("s_name").alias("a"), F.lower("b").alias("b"))
    return R.either_key(n.select("n_nationkey", "n_name"), s, F.lower("n_name"), F.col("a"), F.col("b"), "s_suppkey").select("n_nationkey", "s_suppkey")


@query("""
SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), (SELECT list(DISTINCT string_split(p_name, ' ')[1]) FROM part WHERE p_partkey % 100 = 0))) > 0""")
def list_members(spark: SparkSession, d: str) -> DataFrame:
    """Exact membership in a delimited list."""
    p = read(spark, d, "part").select("p_partkey", "p_name")
    wanted = p.where("p_partkey % 100 = 0").select(F.element_at(F.split("p_name", " "), 1).alias("w"))
    return R.has_member(p, "p_name", " ", wanted, "w").select("p_partkey")


@query("""
WITH x AS (SELECT l_partkey AS k, min(l_returnflag) AS role FROM lineitem GROUP BY 1), o AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'A' ELSE 'N' END AS role FROM part)
SELECT o.k, coalesce(x.role, o.role) AS role, CASE WHEN x.role IS NULL THEN 'own' WHEN x.role = o.role THEN 'kept' ELSE 'moved' END AS how FROM o LEFT JOIN x USING (k)""")
def reconciled_roles(spark: SparkSession, d: str) -> DataFrame:
    """A second source's role takes precedence; rows say whether they moved."""
    x = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_returnflag").alias("xr"))
    o = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 25, "A").otherwise("N").alias("r"))
    return R.reconciled(o, x, "k", "r", "xr").select("k", F.col("r").alias("role"), "how")


@query("""
SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT (n_regionkey <> 3 AND s_suppkey % 4 = 0) GROUP BY 1""")
def dub_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a foreign origin by a native hand are left out."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.where(~R.dubbed(F.col("n_regionkey") != 3, F.col("s_suppkey") % 4 == 0)).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey, quantile_cont(l_extendedprice / l_quantity, 0.5) AS rate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 0 GROUP BY 1""")
def pooled_median(spark: SparkSession, d: str) -> DataFrame:
    """The median of ratios over nested blocks."""
    l = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_extendedprice", "l_quantity")).alias("blocks"))  # an order's lines
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    b = o.select("o_custkey", F.inline("blocks")).where("l_quantity > 0")
    return b.groupBy("o_custkey").agg(F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"))


@query("""
SELECT l_orderkey, round(sum(l_extendedprice), 2) AS runtime, sum(l_linenumber)::BIGINT AS cards, bool_or(l_returnflag = 'R') AS fallback,
coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'R'), '') AS reasons FROM lineitem GROUP BY 1""")
def nested_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sums, any and collected reasons over an item's segments."""
    seg = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")))
    i = read(spark, d, "lineitem").groupBy("l_orderkey").agg(seg.alias("s"), F.sum("l_extendedprice").alias("t"))
    why = F.array_join(F.transform(F.filter("s", lambda x: x["l_returnflag"] == "R"), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ",")
    return i.select("l_orderkey", F.round("t", 2).alias("runtime"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["l_linenumber"]).alias("cards"), F.exists("s", lambda x: x["l_returnflag"] == "R").alias("fallback"), why.alias("reasons"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN l_quantity / 30.0 ELSE l_quantity END, l_linenumber, l_partkey) <= 3 AND l_discount > 0.02""")
def ordered_top(spark: SparkSession, d: str) -> DataFrame:
    """An order over mixed units, and the first three with a positive score."""
    t = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 30.0).otherwise(F.col("l_quantity"))
    l = read(spark, d, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(t, "l_linenumber", "l_partkey")))
    return l.where("r <= 3 and l_discount > 0.02").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT p_partkey, upper(trim(p_name)) AS u, replace(p_name, ' ', '_') AS r, regexp_replace(p_name, '[aeiou]', '', 'g') AS v, length(p_name)::INT AS n, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS b FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name ILIKE '%A%'""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The SQL functions in use."""
    p = read(spark, d, "part").where(F.col("p_size").between(10, 20) & F.col("p_name").ilike("%A%"))
    return p.select("p_partkey", F.upper(F.trim("p_name")).alias("u"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("r"), F.regexp_replace("p_name", "[aeiou]", "").alias("v"), F.length("p_name").alias("n"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("none")).alias("b"))


@query()
def initials_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Shortened names that fit one full name only."""
    w = F.split("p_name", " ")
    p = read(spark, d, "part")
    short = p.select(F.concat(F.left(w[0], F.lit(1)), F.lit(". "), w[1]).alias("short")).distinct()
    return R.unique_containment(short, p.select("p_name").distinct(), "short", "p_name")


@query()
def paired_lines(spark: SparkSession, d: str) -> DataFrame:
    """Left and right texts of a line, unmatched ones with an empty side."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("row"), (F.col("p_partkey") % 200 * 7.0).alias("y"), F.when(F.col("p_size") % 2 == 0, "l").otherwise("r").alias("side"), F.col("p_name").alias("text"))
    return R.line_partners(p, "doc", "y", 5.0)


@query()
def role_partners(spark: SparkSession, d: str) -> DataFrame:
    """The nearest role left of each name, within reach."""
    f = frames(spark, d).select("user_id", "event_id", (F.col("pos") / 2).alias("t"), (F.col("value") * 5).alias("x"), (F.col("event_id") % 300).cast("double").alias("y"))
    names, roles = f.where("event_id % 2 = 0").withColumnRenamed("event_id", "name_id"), f.where("event_id % 2 = 1").withColumnRenamed("event_id", "role_id")
    return R.best_left_partner(names, roles, "user_id", 1.4, 58.0, 400.0).select("user_id", "name_id", "role_id", F.round("score", 6).alias("score"))


@query()
def engine_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The other engine's five most similar texts in reach."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    a, b = c.where("role = 'user'"), c.where("role != 'user'").select("conv_id", F.col("turn").alias("other"), F.col("text").alias("ot"))
    j = a.join(b, "conv_id").where(F.abs(F.col("turn") - F.col("other")) <= 3).withColumn("ratio", S.sequence_ratio_from(0.2)("text", "ot")).where("ratio >= 0.2")
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc("ratio"), "other")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("conv_id", "turn", "other", F.round("ratio", 6).alias("ratio"), "rank")


@query()
def phrase_differences(spark: SparkSession, d: str) -> DataFrame:
    """The longest runs of words that one of two readings lacks."""
    c = spread(turns_before(spark, d))
    r = c.select("conv_id", "turn", F.inline(S.lacking_runs("prev", "text"))).where("n >= 2")
    return r.orderBy(F.desc("n"), "conv_id", "turn", "g").limit(80).select("conv_id", "turn", "op", "phrase", F.col("n").cast("long").alias("n"))


@query()
def fuzzy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Chains of near texts, the most confident of each."""
    p = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("item"), F.col("p_partkey").alias("row"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("confidence"))
    return spellings.fuzzy_clusters(p, "item", "row", "text", "confidence", 0.8)


@query()
def clone_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Near names of which the one with less evidence goes."""
    p = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("item"), F.col("p_partkey").alias("row"), F.col("p_name").alias("text"), (F.col("p_size") % 4).alias("evidence"), (F.col("p_size") > 40).alias("known"))
    return spellings.clone_collapse(p, "item", "row", "text", "evidence", "known", 0.75)


@query()
def upper_prose(spark: SparkSession, d: str) -> DataFrame:
    """X11: prose in Turkish upper case with known names as they are."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    upper = F.array_join(F.transform(F.split("text", " "), lambda w: F.when(w.rlike("^(?:Anna|Paris)"), F.upper(w)).otherwise(T.tr_upper(w))), " ")
    return c.select("conv_id", "turn", F.sha2(F.encode(upper, "utf-8"), 256).alias("text"))


@query("""
WITH e AS (SELECT vec_id, vec_id % 7 AS image, vec_id // 7 AS pos, vec_id - CASE WHEN vec_id // 77 % 2 = 1 THEN 77 ELSE 0 END AS source, vec_id % 5 <> 0 AS textured, 20 + vec_id % 3 AS height FROM embeddings),
s AS (SELECT e.*, list_transform(range(1, len(x.embedding) + 1), lambda k: x.embedding[k]::DOUBLE + CASE WHEN e.vec_id % 13 = 0 THEN k % 3 ELSE 0 END) AS v, (x.vec_id * 2654435761 + e.vec_id % 3)::BIGINT AS hash FROM e JOIN embeddings x ON x.vec_id = e.source),
c AS (SELECT *, list_transform(v, lambda x: x - list_avg(v)) AS d FROM s WHERE textured),
m AS (SELECT a.image, a.pos AS i, b.pos - a.pos AS delta FROM c a JOIN c b ON a.image = b.image AND b.pos - a.pos >= 3 WHERE bit_count(xor(a.hash, b.hash)) <= 10 AND list_dot_product(a.d, b.d) / sqrt(list_dot_product(a.d, a.d) * list_dot_product(b.d, b.d)) >= 0.92),
r AS (SELECT image, delta, min(i) AS lo, max(i) AS hi FROM (SELECT *, i - row_number() OVER (PARTITION BY image, delta ORDER BY i) AS run FROM m) GROUP BY image, delta, run HAVING max(i) > min(i)),
g AS (SELECT DISTINCT image, unnest(range(lo + delta, hi + delta + 1)) AS pos FROM r)
SELECT s.image, (SELECT count(*) FROM r WHERE r.image = s.image) AS blocks, round(coalesce(sum(height) FILTER (textured AND g.pos IS NOT NULL), 0) / sum(height) FILTER (textured), 4) AS dup_ratio FROM s LEFT JOIN g ON s.image = g.image AND s.pos = g.pos GROUP BY s.image""")
def strip_duplication(spark: SparkSession, d: str) -> DataFrame:
    """The share of an image's strips that another part of it shows, by hashes and correlation; every other eleven strips show the
    eleven before them, the others a vector of their own."""
    from ..operators import dedup

    e = read(spark, d, "embeddings")
    i = F.col("vec_id")
    strips = e.select(i, (i % 7).alias("image"), F.floor(i / 7).alias("pos"), (i - F.when(F.floor(i / 77) % 2 == 1, 77).otherwise(0)).alias("source"), (i % 5 != 0).alias("textured"), (20 + i % 3).alias("height"))
    x = e.select(i.alias("source"), F.col("embedding").cast("array<double>").alias("v"))
    vector = F.transform("v", lambda x, k: x + F.when(i % 13 == 0, (k + 1) % 3).otherwise(0))
    rows = strips.join(x, "source").select("image", "pos", "textured", "height", vector.alias("vector"), (F.col("source") * 2654435761 + i % 3).alias("hash"))
    return dedup.strip_duplication(rows, "image").select("image", "blocks", "dup_ratio")
