"""Rule cascades and verdicts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..catalogue import query
from ..functions.text import quality_key
from ..operators import decisions as D
from .relational import read


@query("""
SELECT event_id, value / 100 < coalesce(CASE event_type WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 0.75 WHEN 'view' THEN 0.85 END, 0.5) AS low FROM events""")
def type_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """a flag by each type's own threshold, with a default; no row is dropped."""
    floor = D.type_floor(F.col("event_type"), {"click": 0.5, "purchase": 0.75, "view": 0.85}, 0.5)
    return read(spark, d, "events").select("event_id", (F.col("value") / 100 < floor).alias("low"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN value < 5 THEN 'start' END, CASE WHEN value / 50 > 1 THEN 'confidence' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'type' END) AS errors FROM events""")
def event_errors(spark: SparkSession, d: str) -> DataFrame:
    """what is wrong with a record, as a list."""
    v = F.col("value")
    e = D.event_errors(v - 5, v, v / 50, F.col("event_type"), ["click", "view"])
    return read(spark, d, "events").select("event_id", F.array_join(e, ",").alias("errors"))


@query("""
SELECT event_id, CASE WHEN event_id % 9 < 2 THEN 'unknown' WHEN value / 20 >= 0.55 AND value / 20 >= (event_id % 10) / 2.0 * 1.35 AND (event_id % 7) / 6.0 >= 0.55 THEN 'vertical_scroll'
WHEN (event_id % 10) / 2.0 >= 0.55 AND (event_id % 10) / 2.0 >= value / 20 * 1.35 AND (event_id % 5) / 4.0 >= 0.55 THEN 'horizontal_crawl' WHEN greatest(value / 20, (event_id % 10) / 2.0) < 0.35 AND event_id % 2 = 0 THEN 'static_card' ELSE 'mixed' END AS motion FROM events""")
def motion_classes(spark: SparkSession, d: str) -> DataFrame:
    """classes of motion by ordered rules."""
    i = F.col("event_id")
    m = D.text_motion(i % 10 / 2.0, F.col("value") / 20, i % 9, i % 5 / 4.0, i % 7 / 6.0, i % 2 == 0)
    return read(spark, d, "events").select("event_id", m.alias("motion"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unknown' WHEN p_size / 50.0 > 0.70 AND (p_partkey % 10) / 10.0 < 0.38 THEN 'lower_third' WHEN p_partkey % 4 >= 2 AND (p_partkey % 100) / 1000.0 >= 0.055 THEN 'multi_column' WHEN (p_partkey % 13) / 12.0 < 0.72 THEN 'center_single_column' ELSE 'unknown' END AS layout FROM part""")
def layout_classes(spark: SparkSession, d: str) -> DataFrame:
    """classes of layout by ordered rules."""
    k = F.col("p_partkey")
    c = D.layout_class(k % 11 != 0, F.col("p_size") / 50.0, k % 10 / 10.0, k % 13 / 12.0, k % 4, k % 100 / 1000.0)
    return read(spark, d, "part").select("p_partkey", c.alias("layout"))


@query("""
SELECT p_partkey, CASE WHEN (p_partkey % 21) / 20.0 > 0.95 THEN 'BROKEN_BLACK' WHEN (p_partkey % 23) / 22.0 > 0.95 OR (p_size % 6 = 0 AND (p_partkey % 20) / 100.0 < 0.01) THEN 'BROKEN_EMPTY' WHEN p_size % 6 = 0 THEN 'BROKEN_NO_TEXT'
WHEN (p_partkey % 20) / 100.0 > 0.15 AND (p_partkey % 9) / 40.0 < 0.10 THEN 'BROKEN_BACKGROUND_LEAK' WHEN p_partkey % 8 < 5 AND p_size % 6 < 3 AND (p_partkey % 20) / 100.0 > 0.05 THEN 'BROKEN_SMEAR' WHEN p_size < 15 THEN 'BROKEN_LOW_CONTRAST' WHEN (p_partkey % 17) / 16.0 < 0.4 THEN 'SUSPICIOUS' ELSE 'OK' END AS quality FROM part""")
def output_quality(spark: SparkSession, d: str) -> DataFrame:
    """the first fault that holds."""
    k, s = F.col("p_partkey"), F.col("p_size")
    q = D.output_quality(k % 21 / 20.0, k % 23 / 22.0, k % 20 / 100.0, k % 8, s % 6, k % 9 / 40.0, s, k % 17 / 16.0)
    return read(spark, d, "part").select("p_partkey", q.alias("quality"))


@query("""
SELECT event_id, CASE WHEN value / 100 <= 0.3 THEN 'keep' WHEN event_id % 3 <> 0 THEN 'review' WHEN event_id % 40 > 30 THEN 'review' WHEN (event_id % 10) / 10.0 >= (event_id % 7) / 10.0 + 0.1 THEN 'swap' ELSE 'review' END AS decision FROM events""")
def swap_decisions(spark: SparkSession, d: str) -> DataFrame:
    """C17: keep, swap or review by ordered rules."""
    i = F.col("event_id")
    c = D.swap_decision(F.col("value") / 100, i % 3 == 0, i % 40, i % 7 / 10.0, i % 10 / 10.0, 0.3, 30, 0.1)
    return read(spark, d, "events").select("event_id", c.alias("decision"))


@query("""
SELECT doc_id, CASE WHEN lang IS NULL OR n_chars < 200 THEN 'unknown' WHEN n_chars - doc_id % 1000 < 100 THEN 'mixed' ELSE lang END AS decision FROM documents""")
def language_windows(spark: SparkSession, d: str) -> DataFrame:
    """Unknown, mixed or the language."""
    c = D.language_decision(F.col("n_chars"), F.col("doc_id") % 1000, F.col("lang"), 200, 100)
    return read(spark, d, "documents").select("doc_id", c.alias("decision"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'NOT_APPLICABLE' WHEN doc_id % 3 = 0 THEN 'NOT_EMPTY' WHEN doc_id % 7 = 0 THEN 'EVIDENCE_INSUFFICIENT' WHEN doc_id % 4 = 1 THEN 'MISSED_TEXT' WHEN doc_id % 4 = 2 THEN 'ROLE_ABSENT' WHEN doc_id % 4 = 3 AND n_chars > 500 THEN 'SOURCE_ABSENT' ELSE 'SOURCE_UNREADABLE' END AS state FROM documents""")
def empty_fields(spark: SparkSession, d: str) -> DataFrame:
    """Why a field is empty."""
    i = F.col("doc_id")
    v = F.when(i % 4 == 1, "has_text").when(i % 4 == 2, "role_absent").when(i % 4 == 3, "no_text")
    s = D.empty_field(i % 10 == 0, i % 3 == 0, i % 7 != 0, v, F.when(F.col("n_chars") > 500, "high").otherwise("low"))
    return read(spark, d, "documents").select("doc_id", s.alias("state"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderstatus = 'P' OR o_orderpriority LIKE '1%' THEN 'partial' ELSE 'done' END AS status FROM orders""")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    """A job's status from its parts."""
    s = D.job_status(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok"), F.when(F.col("o_orderpriority").startswith("1"), "degraded").otherwise("ok"))
    return read(spark, d, "orders").select("o_orderkey", s.alias("status"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 AND l_quantity > 40 THEN 'FALSE_POSITIVE' WHEN l_linenumber % 3 = 0 THEN 'AVOIDED_FP' WHEN l_quantity <= 40 THEN 'MISS' WHEN abs(l_quantity - 45) <= 2 THEN 'CORRECT' WHEN l_quantity < 45 THEN 'EARLY' ELSE 'LATE' END AS verdict FROM lineitem""")
def start_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on a start that was found."""
    truth = F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(45)
    v = D.start_verdict(truth, F.when(F.col("l_quantity") > 40, F.col("l_quantity")), 2)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("verdict"))


@query("""
WITH f AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'CAST' END, CASE WHEN c_custkey % 17 = 0 THEN 'IDENTITY' END], lambda x: x IS NOT NULL) AS g, list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'CASING' END, CASE WHEN c_custkey % 4 = 0 THEN 'GENRE' END], lambda x: x IS NOT NULL) AS m FROM customer)
SELECT c_custkey, CASE WHEN len(g) > 0 THEN 'CONTROL' WHEN len(list_filter(m, lambda x: x <> 'GENRE')) > 0 THEN 'REVIEW' ELSE 'CLEAN' END AS tier FROM f""")
def severity_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by grave and mild faults."""
    k = F.col("c_custkey")
    grave = D.flags((F.col("c_acctbal") < 0, "CAST"), (k % 17 == 0, "IDENTITY"))
    mild = D.flags((k % 3 == 0, "CASING"), (k % 4 == 0, "GENRE"))
    return read(spark, d, "customer").select("c_custkey", D.severity(grave, mild, ["GENRE"]).alias("tier"))


@query("""
SELECT bucket, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_orderkey IS NULL THEN 'missing' END, CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END], lambda x: x IS NOT NULL)) AS bucket FROM customer LEFT JOIN orders ON c_custkey = o_custkey) GROUP BY 1""")
def worklist(spark: SparkSession, d: str) -> DataFrame:
    """A left join into buckets that overlap."""
    j = read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    b = D.flags((F.col("o_orderkey").isNull(), "missing"), (F.col("o_totalprice") > 200000, "large"), (F.col("o_orderstatus") == "P", "open"))
    return j.select(F.explode(b).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'speech' ELSE 'music' END AS role, CASE WHEN l_linestatus = 'O' THEN 'tr' WHEN l_quantity > 10 THEN 'en' END AS language, (l_partkey % 4)::INT AS v, l_discount AS c, l_partkey FROM lineitem),
k AS (SELECT *, CASE WHEN role = 'speech' AND language = 'tr' THEN 0 WHEN role = 'speech' THEN 1 WHEN language IS NOT NULL AND v > 0 THEN 2 WHEN language IS NOT NULL THEN 3 ELSE 4 END AS rule FROM r)
SELECT l_orderkey, l_linenumber AS channel, rule FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rule, CASE WHEN rule = 2 THEN -v END NULLS FIRST, CASE WHEN rule = 3 THEN -c END NULLS FIRST, l_linenumber, l_partkey) = 1""")
def channel_choice(spark: SparkSession, d: str) -> DataFrame:
    """The channel that ranked rules choose."""
    l = read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("channel"), F.when(F.col("l_returnflag") == "R", "speech").otherwise("music").alias("role"), F.when(F.col("l_linestatus") == "O", "tr").when(F.col("l_quantity") > 10, "en").alias("language"), (F.col("l_partkey") % 4).cast("int").alias("tr_votes"), F.col("l_discount").alias("confidence"))
    return D.channel_choice(l, "l_orderkey").select("l_orderkey", F.col("channel.l_linenumber").alias("channel"), "rule")


@query("""
WITH s AS (SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey % 5) AS seen FROM lineitem GROUP BY 1, 2), e AS (SELECT l_suppkey, count(DISTINCT l_orderkey % 5) AS episodes FROM lineitem GROUP BY 1)
SELECT l_suppkey, l_partkey, CASE WHEN seen = episodes THEN 'ACTIVE' WHEN episodes >= 3 AND seen = episodes - 1 THEN 'WEAK' ELSE 'CANDIDATE' END AS standing FROM s JOIN e USING (l_suppkey)""")
def membership_standing(spark: SparkSession, d: str) -> DataFrame:
    """Standing by the number of sources that confirm."""
    l = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") % 5).alias("e"))
    s, e = l.groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("e").alias("seen")), l.groupBy("l_suppkey").agg(F.count_distinct("e").alias("episodes"))
    return s.join(e, "l_suppkey").select("l_suppkey", "l_partkey", D.membership(F.col("seen"), F.col("episodes")).alias("standing"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN value > 50 AND event_id % 2 = 0 THEN 'end_time' END, CASE WHEN value > 90 THEN 'confidence' END) AS errors FROM events""")
def timeline_validation(spark: SparkSession, d: str) -> DataFrame:
    """The timeline record's constraints."""
    e = read(spark, d, "events").select("event_id", F.lit("m").alias("media_id"), "event_type", F.col("value").alias("start_time"), F.when((F.col("value") > 50) & (F.col("event_id") % 2 == 0), F.col("value") - 1).otherwise(F.col("value") + 1).alias("end_time"), F.when(F.col("value") > 90, 1.5).otherwise(0.5).alias("confidence"))
    return e.select("event_id", F.array_join(schemas.timeline_errors(), ",").alias("errors"))


_PLAIN = "replace(strip_accents(lower(replace(replace(@, 'İ', 'i'), 'I', 'i'))), 'ı', 'i')"


def _holds(phrases: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{quality_key(p)}')" for p in phrases) + ")"


@query(rf"""
WITH s AS (SELECT doc_id, trim(coalesce(text, '')) AS t, (doc_id % 10) / 10.0 AS ns, -(doc_id % 14) / 10.0 AS lp, CASE WHEN lang = 'en' THEN 'en' ELSE 'tr' END AS language FROM documents),
q AS (SELECT *, trim(regexp_replace(regexp_replace({_PLAIN.replace('@', 't')}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS q, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w FROM s),
k AS (SELECT *, list_transform(w, lambda x: coalesce(nullif(regexp_replace({_PLAIN.replace('@', 'x')}, '[^\p{{L}}\p{{N}}_]', '', 'g'), ''), lower(x))) AS k FROM q),
r AS (SELECT doc_id, ns, lp, language, CASE WHEN NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') THEN 'no_alnum' WHEN {_holds(D.STOCK_PHRASES, 'q')} THEN 'stock_artifact'
WHEN language = 'tr' AND regexp_matches(t, '[\p{{Arabic}}\p{{Han}}\p{{Cyrillic}}\p{{Devanagari}}\p{{Hangul}}\p{{Hebrew}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}]') THEN 'foreign_script_artifact'
WHEN language = 'tr' AND len(string_split(q, ' ')) <= 5 AND {_holds(D.FOREIGN_PHRASES, 'q')} THEN 'short_foreign_phrase_artifact'
WHEN len(list_filter(range(1, len(k) - 18), lambda i: len(list_distinct(k[i:i + 19])) = 1)) > 0 THEN 'repetition_collapse' WHEN regexp_matches(t, '\S{{81}}') THEN 'long_token_artifact'
WHEN lp < -1.15 AND len(w) <= 5 THEN 'very_low_logprob_short_text' WHEN ns > 0.6 AND lp < -1 AND len(w) < 3 THEN 'multi_signal_low_quality' END AS reason FROM k)
SELECT doc_id, reason IS NULL AS keep, reason, CASE WHEN reason IS NULL THEN concat_ws(',', CASE WHEN ns > 0.4 THEN 'high_no_speech_prob' END, CASE WHEN lp < -0.8 THEN 'low_logprob' END, CASE WHEN ns > 0.4 OR lp < -0.8 THEN 'low_confidence' END)
WHEN reason = 'short_foreign_phrase_artifact' THEN 'foreign_phrase_artifact' WHEN reason = 'very_low_logprob_short_text' THEN 'very_low_logprob' WHEN reason IN ('no_alnum', 'multi_signal_low_quality') THEN '' ELSE reason END AS flags FROM r""")
def segment_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Segments dropped by the first rule that holds, others flagged."""
    seg = read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 10 / 10.0).alias("no_speech"), (-(F.col("doc_id") % 14) / 10.0).alias("logprob"), F.when(F.col("lang") == "en", F.col("lang")).otherwise("tr").alias("language"))
    r = D.judge_segments(seg)
    return r.select("doc_id", "keep", F.regexp_replace("drop_reason", ":.*", "").alias("reason"), F.array_join("flags", ",").alias("flags"))


@query()
def result_safety(spark: SparkSession, d: str) -> DataFrame:
    """whether a whole transcript is safe."""
    from ..functions import text as T

    c = read(spark, d, "documents").select("doc_id", "text", T.words("text").alias("w"), (F.col("doc_id") % 300 + 1.0).alias("sec"))
    c = c.withColumns({"run": T.repeat_run(F.col("text"), F.col("w"), 20), "long": T.longest_over(F.col("text"), F.col("w"), 80)})
    why = D.result_safety(F.col("run.run"), F.col("run.token"), F.col("long"), F.size("w"), F.col("sec"), F.col("sec"), F.col("sec") * 0.9)
    return c.select("doc_id", F.regexp_replace(why, ":.*", "").alias("reason"))
