"""Second passes over transcripts, reports on readers, schedules and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import credits, fallback, folds, measures, runs
from .intervals import spans
from .relational import read


def passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two passes' segments: an order's lines by their time, four lines to a chunk; the second lacks or shortens some."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.floor((F.col("l_linenumber") - 1) / 2).alias("chunk"), (F.col("l_linenumber") * 10.0).alias("s"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity") / 5).alias("e"), (F.col("l_returnflag") != "A").alias("clean"), "l_linenumber", "l_partkey")
    second = l.where("l_partkey % 5 != 0").withColumn("e", F.when(F.col("l_partkey") % 3 == 0, F.col("s") + (F.col("e") - F.col("s")) / 2).otherwise(F.col("e")))
    return l, second


_PASSES = """f AS (SELECT l_orderkey AS item, floor((l_linenumber - 1) / 2)::BIGINT AS chunk, l_linenumber * 10.0::DOUBLE AS s, l_linenumber * 10.0::DOUBLE + l_quantity / 5 AS e, l_returnflag <> 'A' AS clean, l_linenumber, l_partkey FROM lineitem),
q AS (SELECT item, chunk, s, CASE WHEN l_partkey % 3 = 0 THEN s + (e - s) / 2 ELSE e END AS e, clean, l_linenumber, l_partkey FROM f WHERE l_partkey % 5 <> 0)"""


@query(f"""
WITH {_PASSES}, c AS (SELECT DISTINCT item, chunk FROM f WHERE (item + chunk) % 2 = 0),
a AS (SELECT c.item, c.chunk, coalesce((SELECT sum(e - s) FROM f WHERE f.item = c.item AND f.chunk = c.chunk AND clean), 0) AS x, coalesce((SELECT sum(e - s) FROM q WHERE q.item = c.item AND q.chunk = c.chunk AND clean), 0) AS y FROM c),
t AS (SELECT item, chunk FROM a WHERE NOT (x > 0 AND y + 1 < x AND y < x * 0.95))
SELECT item, l_linenumber, l_partkey, 'fast' AS source FROM f ANTI JOIN t USING (item, chunk) UNION ALL SELECT item, l_linenumber, l_partkey, 'quality' FROM q SEMI JOIN t USING (item, chunk)""")
def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks taken from the second pass, but those where it regressed."""
    fast, quality = passes(spark, d)
    chosen = fast.where("(item + chunk) % 2 = 0").select("item", "chunk")
    return fallback.replaced_chunks(fast, quality, chosen).select("item", "l_linenumber", "l_partkey", "source")


@query("""
WITH f AS (SELECT l_orderkey AS item, floor((l_linenumber - 1) / 2)::BIGINT AS chunk, l_linenumber, l_discount, l_tax FROM lineitem),
r AS (SELECT o_orderkey AS item, CASE o_orderkey % 5 WHEN 0 THEN 'quality_drop:x' WHEN 1 THEN 'tail_gap_uncovered:gap=4.00s' WHEN 2 THEN 'vad_gap_uncovered' ELSE 'low_coverage' END AS failure, CASE WHEN o_orderkey % 7 = 0 THEN 'tail_gap_uncovered' END AS safety, (o_orderkey % 60)::DOUBLE AS last_end FROM orders),
c AS (SELECT DISTINCT item, chunk, chunk * 20.0::DOUBLE AS s, chunk * 20.0::DOUBLE + 19 AS e FROM f),
u AS (SELECT f.item, chunk, 0 AS k FROM f JOIN r USING (item) WHERE failure LIKE 'quality_drop:%' AND l_discount > 0.08
UNION ALL SELECT c.item, c.chunk, 0 FROM c JOIN r USING (item) WHERE (failure LIKE 'tail_gap_uncovered%' OR safety LIKE 'tail_gap_uncovered%') AND (e > last_end OR last_end BETWEEN s AND e)
UNION ALL SELECT c.item, c.chunk, 0 FROM c JOIN r USING (item) WHERE failure LIKE 'vad_gap_uncovered%' AND e > (item % 50) AND s < (item % 50) + 5
UNION ALL SELECT item, chunk, 1 FROM f WHERE l_tax > 0.07 UNION ALL SELECT item, chunk, 2 FROM c)
SELECT DISTINCT item, chunk FROM (SELECT *, min(k) OVER (PARTITION BY item) AS least FROM u) WHERE k = least""")
def fallback_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a second pass, by ordered rules."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.floor((F.col("l_linenumber") - 1) / 2).alias("chunk"), "l_discount", "l_tax")
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    failure = F.when(k % 5 == 0, "quality_drop:x").when(k % 5 == 1, "tail_gap_uncovered:gap=4.00s").when(k % 5 == 2, "vad_gap_uncovered").otherwise("low_coverage")
    r = o.select(k.alias("item"), failure.alias("failure"), F.when(k % 7 == 0, "tail_gap_uncovered").alias("safety"), (k % 60).cast("double").alias("last_end"))
    chunks = l.select("item", "chunk").distinct().select("item", "chunk", (F.col("chunk") * 20.0).alias("s"), (F.col("chunk") * 20.0 + 19).alias("e"))
    drops = l.select("item", "chunk", F.when(F.col("l_discount") > 0.08, "repetition_collapse:x").otherwise("no_alnum").alias("reason"))
    gaps = o.select(k.alias("item"), (k % 50).cast("double").alias("gs"), (k % 50 + 5).cast("double").alias("ge"))
    segments = l.select("item", "chunk", F.when(F.col("l_tax") > 0.07, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return fallback.fallback_chunks(r, chunks, drops, gaps, segments)


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'f' END AS fr, CASE WHEN event_id % 4 = 0 THEN 'q' END AS qr, value AS fe, (event_id % 100)::DOUBLE AS qe FROM events),
s AS (SELECT *, fr IS NOT NULL AND qr IS NOT NULL AS bo, qe + 1 < fe AND least(1, qe / 100) + 0.05 < least(1, fe / 100) AS shorter FROM r)
SELECT event_id, CASE WHEN bo AND qe >= fe THEN 'quality' WHEN bo THEN 'fast' WHEN qr IS NOT NULL THEN 'fast' WHEN fr IS NOT NULL THEN 'quality' WHEN shorter THEN 'fast' ELSE 'quality' END AS kept,
CASE WHEN bo THEN 'degraded_both_unsafe' WHEN qr IS NOT NULL THEN 'kept_fast:quality_unsafe:q' WHEN fr IS NOT NULL THEN 'selected_quality:fast_unsafe:x' WHEN shorter THEN 'kept_fast:quality_coverage_worse' ELSE 'selected_quality:fallback_reason=x' END AS reason FROM s""")
def selected_results(spark: SparkSession, d: str) -> DataFrame:
    """C14: which of two whole results stands."""
    i = F.col("event_id")
    r = fallback.select_result(F.when(i % 3 == 0, "f"), F.when(i % 4 == 0, "q"), F.col("value"), (i % 100).cast("double"), F.lit(100.0), F.lit("x"))
    return read(spark, d, "events").select("event_id", r.alias("r")).select("event_id", "r.kept", F.regexp_replace("r.reason", "^(degraded_both_unsafe|kept_fast:quality_coverage_worse):.*", "$1").alias("reason"))


@query("""
WITH x AS (SELECT DISTINCT l_suppkey AS film, l_returnflag AS model, l_partkey AS line FROM lineitem), v AS (SELECT film, line, count(*) AS votes FROM x GROUP BY 1, 2),
o AS (SELECT x.film, model, count(*) AS n, count(*) FILTER (votes > 1) AS shared FROM x JOIN v USING (film, line) GROUP BY 1, 2), w AS (SELECT film, count(*) AS al FROM v GROUP BY 1),
j AS (SELECT a.film, a.model, avg(i / (a.n + b.n - i)) AS agree FROM (SELECT a.film, a.model, a.n, b.model AS other, b.n AS m, (SELECT count(*) FROM x p JOIN x q ON p.film = q.film AND p.line = q.line WHERE p.film = a.film AND p.model = a.model AND q.model = b.model) AS i FROM o a JOIN o b ON a.film = b.film AND a.model <> b.model) a JOIN o b ON a.film = b.film AND b.model = a.other GROUP BY 1, 2)
SELECT o.model, count(*) AS films, sum(n)::BIGINT AS lines, round(avg(agree), 3) AS agreement, round(avg(n / al), 3) AS coverage, round(avg(shared / n), 3) AS consensus_precision FROM o JOIN w USING (film) LEFT JOIN j ON o.film = j.film AND o.model = j.model GROUP BY 1""")
def model_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Agreement, coverage and consensus precision of readers over sets of lines."""
    return fallback.leaderboard(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("film"), F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("line")))


@query("""
SELECT s_suppkey, round(levenshtein(reverse(s_name), s_name) / length(s_name), 4) AS cer, CASE WHEN s_suppkey % 4 <> 0 THEN round((s_suppkey % 9 + 1) / (s_suppkey % 4), 3) END AS speedup FROM supplier""")
def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    """Error rate and speed-up of each benchmark row."""
    from ..functions import similarity as S

    k = F.col("s_suppkey")
    fast = F.when(k % 4 != 0, (k % 4).cast("double"))
    return read(spark, d, "supplier").select("s_suppkey", F.round(S.char_error_rate(F.col("s_name"), F.reverse("s_name")), 4).alias("cer"), F.round((k % 9 + 1) / fast, 3).alias("speedup"))


@query("""
SELECT 1 AS k, 'not_final_fast_safety_failures:' || string_agg(s_name, ',' ORDER BY s_name) AS hint FROM supplier WHERE s_suppkey % 40 = 0
UNION ALL SELECT 2, 'awaiting_reference_transcripts' UNION ALL SELECT 3, 'ready_for_manual_decision_review'""")
def decision_hints(spark: SparkSession, d: str) -> DataFrame:
    """The hint over all rows."""
    s = read(spark, d, "supplier").select(F.col("s_name").alias("sample"), (F.col("s_suppkey") % 40 != 0).alias("safe"), (F.col("s_suppkey") % 2 == 0).alias("even"))
    one = lambda k, ready, safe: fallback.decision_hint(s.select("sample", ready.alias("reference_ready"), safe.alias("fast_safe"))).select(F.lit(k).alias("k"), "hint")
    return one(1, F.lit(True), F.col("safe")).unionByName(one(2, F.col("even"), F.col("safe"))).unionByName(one(3, F.lit(True), F.lit(True)))


@query("""
SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS mapped FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END""")
def status_drift(spark: SparkSession, d: str) -> DataFrame:
    """Statuses that differ from what their decisions map to."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    mapped = F.when(k % 3 == 0, "F").when(k % 5 != 0, F.col("o_orderstatus"))
    return fallback.drift(o.select("o_orderkey", F.col("o_orderstatus").alias("status")), o.where(k % 2 == 0).select("o_orderkey", mapped.alias("mapped")), "o_orderkey")


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'SCROLL' ELSE 'UNKNOWN' END AS type, l_quantity * 2 AS sec, (l_orderkey % 20) / 20.0 AS c FROM lineitem),
n AS (SELECT *, lag(type) OVER w AS a, lead(type) OVER w AS b, count(*) OVER (PARTITION BY l_orderkey) AS n FROM g WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN type = 'UNKNOWN' AND a = 'SCROLL' AND b = 'SCROLL' AND sec <= 60 AND n >= 3 AND c >= 0.85 THEN 'SCROLL_INFERRED' ELSE type END AS type FROM n""")
def gated_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Unknown segments between two of a kind, where the whole recording is sure."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("o"), F.when(F.col("l_returnflag") == "N", "SCROLL").otherwise("UNKNOWN").alias("type"), (F.col("l_quantity") * 2).alias("sec"))
    return runs.bridged(l, "l_orderkey", "o", "type", "sec", F.col("l_orderkey") % 20 / 20.0, "SCROLL").select("l_orderkey", "l_linenumber", "l_partkey", "type")


@query("""
WITH v AS (SELECT user_id, epoch(ts) AS t, value AS y FROM events), d AS (SELECT user_id, t - lag(t) OVER w AS dt, y - lag(y) OVER w AS dy FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t, y)),
a AS (SELECT user_id, count(*) AS births, count(*) FILTER (dt >= 0.25 AND abs(dy) >= 8) AS votes, count(*) FILTER (dt >= 0.25 AND dy >= 8) AS down FROM d GROUP BY 1)
SELECT user_id, votes, CASE WHEN births < 3 OR votes < 2 THEN 0 ELSE round(greatest(down, votes - down) / votes * least(1, votes / 5), 4) END AS hint FROM a""")
def direction_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes on a direction between tracks born one after another."""
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t"), F.col("value").alias("y"))
    return measures.direction_votes(e, "user_id", "t", "y")


@query("""
SELECT p_partkey, len(list_filter([(p_partkey % 11)::DOUBLE, p_size / 5.0, (p_partkey % 7)::DOUBLE], lambda x: x < 1)) >= 1 OR len(list_filter([(p_partkey % 11)::DOUBLE, p_size / 5.0, (p_partkey % 7)::DOUBLE], lambda x: x < 3)) >= 2 AS garbled FROM part""")
def garble_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """One token under a limit, or two under another."""
    s = F.array((F.col("p_partkey") % 11).cast("double"), F.col("p_size") / 5.0, (F.col("p_partkey") % 7).cast("double"))
    return read(spark, d, "part").select("p_partkey", measures.garble_verdict(s, 1.0, 3.0).alias("garbled"))


@query("""
WITH r AS (SELECT p_partkey, (p_partkey % 1300)::INT AS n, p_size AS prop FROM part), s AS (SELECT *, n / 1.5 AS sec FROM r),
k AS (SELECT p_partkey, n, 0 AS pos FROM s WHERE n > 0 UNION ALL SELECT p_partkey, n, n - 1 FROM s WHERE n > 0 UNION ALL SELECT p_partkey, n, prop FROM s WHERE n > prop
UNION ALL SELECT p_partkey, n, least(n - 1, floor(i * 15 * 1.5 + 0.5)::INT) FROM (SELECT *, unnest(range(0, 60)) AS i FROM s) WHERE i * 15 < sec - 1e-12
UNION ALL SELECT p_partkey, n, least(n - 1, floor((greatest(0, sec - 90) + i * 4) * 1.5 + 0.5)::INT) FROM (SELECT *, unnest(range(0, 25)) AS i FROM s) WHERE greatest(0, sec - 90) + i * 4 < sec - 1e-12)
SELECT p_partkey, count(DISTINCT pos) AS n, sum(DISTINCT pos)::BIGINT AS total FROM k GROUP BY 1""")
def sample_schedules(spark: SparkSession, d: str) -> DataFrame:
    """where to look: a wide cadence, a dense one at the end, and proposals."""
    at = measures.sample_schedule((F.col("p_partkey") % 1300).cast("int"), F.array("p_size"))
    p = read(spark, d, "part").select("p_partkey", F.explode(at).alias("at"))
    return p.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum(F.col("at").cast("long")).alias("total"))


@query()
def language_samples(spark: SparkSession, d: str) -> DataFrame:
    """long enough regions, evenly spaced, cut to a target and a budget."""
    s, by = spans(spark, d).where("e - s >= 3"), Window.partitionBy("user_id")
    n = F.count("*").over(by)
    take = F.least(n, F.lit(6))
    place = F.row_number().over(by.orderBy("s", "event_id")) - 1
    spots = F.transform(F.sequence(F.lit(0), take - 1), lambda i: F.when(take == 1, F.lit(0)).otherwise(F.bround(i * (n - 1) / F.greatest(F.lit(1), take - 1)).cast("int")))
    chosen = s.withColumns({"_p": place, "_at": spots}).where(F.array_contains("_at", F.col("_p"))).select("user_id", "s", "e", "event_id")
    return folds.grouped(chosen, "user_id", ["s", "event_id"], folds.budgeted_prefix(3.0, 8.0, 30.0), "user_id long, s double, e double")


@query()
def dialect_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a dialect in standard form."""
    names = list(credits.DIALECTS)
    word = F.get(F.array(*[F.lit(w) for n in names for w, _ in credits.DIALECTS[n]]), (F.col("p_partkey") % sum(map(len, credits.DIALECTS.values()))).cast("int"))
    p = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", word, F.lit("كتاب")).alias("text"))
    v = credits.dialect(F.col("text"))
    return p.withColumn("variant", v).select("p_partkey", "variant", credits.standard_arabic(F.col("text"), F.col("variant")).alias("text"))
