"""Joins, aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import dedup, measures
from ..operators import relational as R
from ..operators.quantiles import exact_quantiles
from ..sources import logs


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to as many tasks as shuffles have, for what takes long a row: small tables would go to one or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query("""
SELECT o_custkey AS grp, count(DISTINCT l_partkey) AS shared FROM orders JOIN lineitem ON o_orderkey = l_orderkey
JOIN part ON l_partkey = p_partkey WHERE p_size >= 40 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3 ORDER BY shared DESC, grp LIMIT 50""")
def shared_members_topk(spark: SparkSession, d: str) -> DataFrame:
    """Groups with most distinct members among wanted ones."""
    pairs = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("grp"), F.col("l_partkey").alias("p_partkey"))
    return R.shared_members(pairs, "grp", "p_partkey", read(spark, d, "part").where("p_size >= 40"), 3, 50)


@query("""
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey
WHERE lower(c_mktsegment) = 'building' ORDER BY o_totalprice DESC NULLS LAST, c_custkey, o_orderkey LIMIT 100""")
def left_join_rank_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """A left join on folded equality, ranked with nulls last."""
    c = read(spark, d, "customer").where(F.lower("c_mktsegment") == "building")
    j = c.join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.orderBy(F.desc_nulls_last("o_totalprice"), "c_custkey", "o_orderkey").limit(100).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23' AND l_quantity < 5")
def filtered_equi_join(spark: SparkSession, d: str) -> DataFrame:
    """An inner join filtered on both sides."""
    p = read(spark, d, "part").where("p_brand = 'Brand#23'").select("p_partkey", "p_name")
    return read(spark, d, "lineitem").where("l_quantity < 5").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("""
SELECT l_orderkey, l_linenumber, p_name, rn FROM (SELECT l_orderkey, l_linenumber, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn
FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE rn <= 3""")
def ordered_members(spark: SparkSession, d: str) -> DataFrame:
    """The first members of each group in their order, enriched."""
    j = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).where("rn <= 3")
    return j.join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "rn")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key is among a set made at run time."""
    keys = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.keys_in(read(spark, d, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@query("""
SELECT 'customer' AS src, c_name AS name, c_nationkey AS nation FROM customer
UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier WHERE upper(trim(s_name)) NOT IN (SELECT upper(trim(c_name)) FROM customer)""")
def anti_join_merge(spark: SparkSession, d: str) -> DataFrame:
    """A fallback source's rows whose key the primary one lacks."""
    a = read(spark, d, "customer").select(F.lit("customer").alias("src"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = read(spark, d, "supplier").select(F.lit("supplier").alias("src"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return R.add_missing(a, b, F.upper(F.trim("name")))


@query("""
WITH l AS (SELECT r_regionkey, string_agg(n_nationkey::VARCHAR, '|' ORDER BY n_name DESC) AS ids FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT r_regionkey AS region, array_to_string(list(n_name ORDER BY pos), ',') AS labels
FROM (SELECT r_regionkey, unnest(string_split(ids, '|'))::INT AS id, generate_subscripts(string_split(ids, '|'), 1) AS pos FROM l) JOIN nation ON n_nationkey = id GROUP BY 1""")
def delimited_deref(spark: SparkSession, d: str) -> DataFrame:
    """A delimited list of ids to its labels, in order."""
    n = read(spark, d, "nation")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey")), False), lambda x: x["n_nationkey"].cast("string")), "|")
    lists = n.groupBy(F.col("n_regionkey").alias("region")).agg(ids.alias("ids"))
    table = n.select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return R.deref(lists, "region", F.split("ids", r"\|"), table, "k", F.col("n_name")).select("region", F.array_join("labels", ",").alias("labels"))


@query("""
WITH q AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS needle FROM part),
     f AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g')) AS t FROM part)
SELECT needle, p_partkey, min(CASE WHEN t = needle THEN 1 ELSE 2 END) AS pass FROM q JOIN f ON contains(t, needle) GROUP BY 1, 2""")
def two_pass_title_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact fold, then substring; an id once, by its best pass."""
    p = read(spark, d, "part").select("p_partkey", "p_name")
    q = p.select(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("needle")).distinct()
    return R.two_pass(q, p, "needle", "p_name", "p_partkey").select("needle", "p_partkey", "pass")


@query("""
SELECT event_id, ts, event_type, value FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-02 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 200""")
def event_filter_tail(spark: SparkSession, d: str) -> DataFrame:
    """Optional filters, newest first, limit within [1, 2000]."""
    return logs.select(read(spark, d, "events"), 200, "2024-01-02 00:00:00", "ts", event_type="click").select("event_id", "ts", "event_type", "value")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 42")
def event_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A point lookup by id, pushed down to the scan."""
    return logs.find(read(spark, d, "events"), 42).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 7")
def events_of_one(spark: SparkSession, d: str) -> DataFrame:
    """One key's events in order of time."""
    return read(spark, d, "events").where("user_id = 7").orderBy("ts", "event_id").select("event_id", "ts", "event_type")


@query("""
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1""")
def distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, tails, quartiles, mean and population deviation."""
    return measures.stats(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 4)


@query("SELECT event_type, round(quantile_cont(value, 0.95) * 1.3, 4) AS threshold FROM events GROUP BY 1")
def derived_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds from a distribution."""
    q = exact_quantiles(read(spark, d, "events"), ["event_type"], "value", [0.95])
    return q.select("event_type", F.round(F.col("q")[0] * 1.3, 4).alias("threshold"))


@query("""
SELECT 'lang' AS dimension, lang AS value, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY source""")
def category_rollups(spark: SparkSession, d: str) -> DataFrame:
    """A10: one independent grouping for each dimension."""
    return measures.each_dimension(read(spark, d, "documents").select("lang", "source", "n_chars"), ["lang", "source"], F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals, subtotals and the grand total."""
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT lang, sum(n_chars)::BIGINT AS weight, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY lang""")
def language_share(spark: SparkSession, d: str) -> DataFrame:
    """Each language's share of the weight."""
    return measures.shares(read(spark, d, "documents"), "lang", F.col("n_chars"))


@query("""
WITH s AS (SELECT lang, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY lang),
     m AS (SELECT * FROM s WHERE lang NOT IN ('mixed', 'unknown') ORDER BY share DESC, lang LIMIT 1)
SELECT CASE WHEN share >= 0.5 THEN lang END AS lang, share FROM m""")
def language_dominant(spark: SparkSession, d: str) -> DataFrame:
    """The dominant language, if it has half of the weight."""
    return measures.dominant(measures.shares(read(spark, d, "documents"), "lang", F.col("n_chars")), "lang", 0.5, ["mixed", "unknown"])


@query("""
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value, with a tiebreak."""
    return measures.mode(read(spark, d, "events"), "user_id", "event_type")


@query("""
SELECT bucket, count(*) AS count FROM (SELECT CASE WHEN l_discount >= 0 AND l_discount < 0.02 THEN 0 WHEN l_discount < 0.05 THEN 1 WHEN l_discount <= 0.1 THEN 2 END AS bucket FROM lineitem)
WHERE bucket IS NOT NULL GROUP BY 1""")
def histogram_fixed_edges(spark: SparkSession, d: str) -> DataFrame:
    """A histogram of uneven edges, the last bucket closed."""
    return measures.histogram(read(spark, d, "lineitem"), F.col("l_discount"), [0, 0.02, 0.05, 0.1])


@query("""
SELECT o_custkey, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS closed, round(sum((o_orderstatus = 'F')::INT) / count(*), 6) AS ratio,
CASE WHEN sum((o_orderstatus = 'F')::INT) = 0 THEN 'none' WHEN sum((o_orderstatus = 'F')::INT) = count(*) THEN 'all' ELSE 'some' END AS coverage FROM orders GROUP BY 1""")
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts, coverage and its status."""
    c = F.count_if(F.col("o_orderstatus") == "F")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), c.alias("closed")).select("*", F.round(F.col("closed") / F.col("n"), 6).alias("ratio"), F.when(F.col("closed") == 0, "none").when(F.col("closed") == F.col("n"), "all").otherwise("some").alias("coverage"))


@query("""
SELECT l_returnflag, round(sum(l_discount * greatest(0.001, l_quantity)) / sum(greatest(0.001, l_quantity)), 6) AS l_discount,
round(sum(l_tax * greatest(0.001, l_quantity)) / sum(greatest(0.001, l_quantity)), 6) AS l_tax FROM lineitem GROUP BY 1""")
def weighted_averages(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means with a floor on the weight."""
    w = measures.weighted(read(spark, d, "lineitem"), "l_returnflag", ["l_discount", "l_tax"], "l_quantity")
    return w.select("l_returnflag", F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


@query("""
SELECT o_custkey, arg_max(o_orderkey, o_totalprice * 1000000 - o_orderkey / 1000000.0) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""")
def best_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each key, first of equals."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.best_of(o, F.col("o_custkey"), [F.col("o_totalprice"), -F.col("o_orderkey")])


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus IN ('F', 'P')) WHERE r = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each key among some classes."""
    o = read(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P"))
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")


@query("""
WITH a AS (SELECT s_nationkey, p_brand, avg(l_discount) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1, 2)
SELECT s_nationkey, p_brand, round(m, 6) AS metric, round(m - max(CASE WHEN p_brand = 'Brand#11' THEN m END) OVER (PARTITION BY s_nationkey), 6) AS delta FROM a""")
def baseline_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Each variant's difference to the base variant of its group."""
    l = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_discount")
    p = read(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select("p_partkey", "p_brand")
    a = l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "p_brand").agg(F.avg("l_discount").alias("m"))
    return measures.deltas(a, "s_nationkey", "p_brand", "Brand#11", "m").select("s_nationkey", "p_brand", F.round("m", 6).alias("metric"), F.round("delta", 6).alias("delta"))


@query("""
WITH j AS (SELECT lang, quality = 1 AS truth, n_chars >= 1000 AS guess FROM documents JOIN labels USING (doc_id)),
     a AS (SELECT lang, sum((truth AND guess)::INT)::BIGINT AS tp, sum((NOT truth AND guess)::INT)::BIGINT AS fp, sum((truth AND NOT guess)::INT)::BIGINT AS fn FROM j GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM a""")
def precision_recall_f1(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of a rule."""
    j = read(spark, d, "documents").select("doc_id", "lang", "n_chars").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return measures.precision_recall(j, ["lang"], F.col("quality") == 1, F.col("n_chars") >= 1000)


@query("""
SELECT lang, corr_docs.c AS correlation FROM (SELECT lang, round(CASE WHEN min(doc_id) = max(doc_id) OR min(n_chars) = max(n_chars) THEN 0 ELSE corr(doc_id, n_chars) END, 6) AS c FROM documents GROUP BY lang) AS corr_docs""")
def guarded_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson's correlation with its degenerate cases."""
    from ..functions.similarity import correlation

    return read(spark, d, "documents").groupBy("lang").agg(F.round(correlation(F.col("doc_id").cast("double"), F.col("n_chars").cast("double")), 6).alias("correlation"))


@query("""
WITH v AS (SELECT DISTINCT o_custkey, l_suppkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
     c AS (SELECT o_custkey, l_suppkey, count(*) AS votes, max((l_suppkey % 10 = o_custkey % 10)::INT) = 1 AS director_match FROM v GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(votes) OVER w, 0) AS nxt FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY votes + CASE WHEN director_match THEN 3 ELSE 0 END DESC, votes DESC, l_suppkey DESC))
SELECT o_custkey, l_suppkey, votes, director_match, nxt >= 3 AND nxt >= votes - 1 AS ambiguous,
CASE WHEN (votes >= 3 OR (director_match AND votes >= 2)) AND NOT (nxt >= 3 AND nxt >= votes - 1) THEN 'CERTAIN' ELSE 'REVIEW' END AS status FROM r WHERE rn = 1""")
def vote_identity(spark: SparkSession, d: str) -> DataFrame:
    """The candidate with most voters, gated and checked against the runner-up."""
    v = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    none = F.lit(None).cast("int")
    return R.vote_identity(v, "o_custkey", "l_suppkey", "l_partkey", (F.col("l_suppkey") % 10) == (F.col("o_custkey") % 10), none, none)


@query("""
SELECT n_name, coalesce(CASE n_regionkey WHEN 1 THEN 'west' WHEN 2 THEN 'east' END, 'rest') AS route FROM nation""")
def route_default(spark: SparkSession, d: str) -> DataFrame:
    """A route table with a default."""
    routes = spark.createDataFrame([("1", "west"), ("2", "east"), ("*", "rest")], "k string, route string")
    n = read(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("k"))
    return R.route(n, routes, "k", "route", "none").select("n_name", "route")


@query("""
SELECT p_partkey, arg_min(s, abs(p_size - s) * 1000 + s) AS s FROM part, (SELECT unnest([5, 15, 25, 40]) AS s) WHERE abs(p_size - s) <= 3 GROUP BY 1""")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    """The nearest value within reach."""
    t = spark.createDataFrame([("x", v) for v in (5, 15, 25, 40)], "k string, s int")
    return R.nearest_value(read(spark, d, "part").select("p_partkey", "p_size", F.lit("x").alias("k")), t, "k", "p_partkey", "p_size", "s", 3)


@query("""
WITH n AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part), m AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS other FROM part)
SELECT name, other, levenshtein(name, other) AS edits FROM n, m WHERE levenshtein(name, other) <= 1""")
def one_edit_join(spark: SparkSession, d: str) -> DataFrame:
    """A fuzzy join made an equality join by deletion neighbourhoods."""
    w = F.split("p_name", " ")
    p = read(spark, d, "part")
    return R.one_edit_join(p.select(w[0].alias("name")).distinct(), p.select(w[1].alias("other")).distinct(), "name", "other")


@query("""
WITH a AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS l FROM part), b AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS r FROM part),
     p AS (SELECT l, r, jaro_winkler_similarity(l, r) AS score FROM a JOIN b ON left(l, 1) = left(r, 1) AND abs(length(l) - length(r)) <= 3 WHERE jaro_winkler_similarity(l, r) >= 0.5),
     k AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY l ORDER BY score DESC, r))
SELECT l, r, round(score, 6) AS score FROM k WHERE n = 1 AND (nxt IS NULL OR score - nxt >= 0.0)""")
def jw_block_join(spark: SparkSession, d: str) -> DataFrame:
    """Jaro-Winkler within blocks of first letter and length."""
    p = read(spark, d, "part").withColumn("w", F.split("p_name", " "))
    a, b = p.select(F.get("w", F.lit(0)).alias("l")), p.select(F.get("w", F.lit(1)).alias("r")).where("r is not null")
    return R.blocked_similar(a, b, "l", "r", 0.5, 0.0).select("l", "r", F.round("score", 6).alias("score"))


@query("""
SELECT round(sum((word = 'x')::INT), 0)::BIGINT AS hits, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)""")
def array_explode_count(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies over exploded arrays."""
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).agg(F.count_if(F.col("word") == "x").alias("hits"), F.count("*").alias("n"))


@query("""
WITH v(k, f, a, b) AS (SELECT s_suppkey, 'name', s_name, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR, CASE WHEN s_suppkey % 7 = 0 THEN '99' ELSE s_nationkey::VARCHAR END FROM supplier)
SELECT k, f, a AS was, b AS now, f = 'name' AND a <> '' AND b = '' AS blocked FROM v WHERE a <> b""")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ between versions, blocked where a gated one goes empty."""
    from ..operators import decisions

    s = read(spark, d, "supplier")
    def long(name: Column, nation: Column) -> DataFrame:
        return s.select(F.col("s_suppkey").alias("k"), F.inline(F.array(F.struct(F.lit("name").alias("f"), name.alias("v")), F.struct(F.lit("nation").alias("f"), nation.alias("v")))))

    key = F.col("s_suppkey")
    nation = F.col("s_nationkey").cast("string")
    return decisions.field_diff(long(F.col("s_name"), nation), long(F.when(key % 5 == 0, "").otherwise(F.col("s_name")), F.when(key % 7 == 0, "99").otherwise(nation)), "k", "f", "v", ["name"])


@query("SELECT s_suppkey, sha256(concat_ws('|', s_suppkey::VARCHAR, s_name)) AS seal FROM supplier")
def seals(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes that bind a decision to what it saw."""
    from ..operators import decisions

    return read(spark, d, "supplier").select("s_suppkey", decisions.seal(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("seal"))


@query("""
SELECT b.l_partkey AS part, count(DISTINCT a.l_suppkey) AS n_left, list_sort(list(DISTINCT b.l_suppkey))::VARCHAR AS members FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') a
JOIN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') b ON a.l_partkey = b.l_partkey GROUP BY 1""")
def set_members(spark: SparkSession, d: str) -> DataFrame:
    """Sets collected by key on two sides."""
    l = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    a, b = l.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_left")), l.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("m"))
    return a.join(b, "l_partkey").select(F.col("l_partkey").alias("part"), "n_left", F.concat(F.lit("["), F.array_join(F.col("m").cast("array<string>"), ", "), F.lit("]")).alias("members"))
