"""Normalisers, similarity and text measures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import similarity as S
from ..functions import text as T
from ..operators import dedup, measures
from ..sources import files
from .relational import read, spread

_TF = "trim(lower(translate(text, 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc')))"
_MARKS = f"'{T.MARKED}', '{T.PLAIN}'"


@query(f"SELECT doc_id, sha256({_TF}) AS fold FROM documents")
def turkish_fold(spark: SparkSession, d: str) -> DataFrame:
    """Turkish letters to plain lower case."""
    return read(spark, d, "documents").select("doc_id", F.sha2(F.encode(T.tr_fold("text"), "utf-8"), 256).alias("fold"))


@query(f"""
SELECT doc_id, sha256(trim(regexp_replace(translate(lower(translate(text, 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc')), {_MARKS}), '[^a-z0-9 ]', ' ', 'g'))) AS ascii,
sha256(trim(regexp_replace(translate(lower(translate(text, 'İI', 'ii')), {_MARKS}), '[^a-z0-9]+', ' ', 'g'))) AS cast_key,
sha256(trim(regexp_replace(upper(translate(replace(text, 'ß', 'SS'), 'İıŞşĞğÜüÖöÇç', 'IISSGGUUOOCC')), '[^A-Z0-9]+', ' ', 'g'))) AS screen FROM documents""")
def folds(spark: SparkSession, d: str) -> DataFrame:
    """Three different normalisers."""
    h = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return read(spark, d, "documents").select("doc_id", h(T.ascii_fold("text")).alias("ascii"), h(T.cast_fold("text")).alias("cast_key"), h(T.screen_text("text")).alias("screen"))


@query()
def other_folds(spark: SparkSession, d: str) -> DataFrame:
    """Normalisers whose case tables SQL engines differ in."""
    h = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return read(spark, d, "documents").select("doc_id", h(T.upper_key("text")).alias("upper_key"), h(T.quality_text("text")).alias("quality"), h(T.plain_upper("text")).alias("plain"), h(T.tr_upper("text")).alias("tr_upper"))


@query("""
SELECT conv_id, turn, CASE WHEN strpos(lower(text), 'the') = 0 THEN trim(substr(text, 1, 180)) ELSE
CASE WHEN greatest(0, strpos(lower(text), 'the') - 1 - 90) > 0 THEN '...' ELSE '' END || trim(substr(text, greatest(0, strpos(lower(text), 'the') - 91) + 1, least(length(text), strpos(lower(text), 'the') + 92) - greatest(0, strpos(lower(text), 'the') - 91))) ||
CASE WHEN strpos(lower(text), 'the') + 92 < length(text) THEN '...' ELSE '' END END AS snippet FROM conversations""")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The text around a match."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.snippet("text", "the").alias("snippet"))


@query("""
SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) >= 4 GROUP BY 1 ORDER BY count DESC, word LIMIT 50""")
def keywords_topk(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words."""
    w = read(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).where(F.length("word") >= 4)
    return measures.top_terms(w, "word", 50)


@query("""
WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS k FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations))
SELECT conv_id, turn, count(*) AS n, max(length(trim(s)))::INT AS longest FROM s WHERE length(trim(s)) >= 25 GROUP BY 1, 2""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a least length."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.explode(T.sentences("text")).alias("s"))
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.length("s")).alias("longest"))


@query()
def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of whole texts with the most frequent words, in their order."""
    s = read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("k", "s"))
    w = s.select("doc_id", "k", F.explode(F.filter(F.split(F.lower("s"), "[^a-z]+"), lambda x: F.length(x) > 3)).alias("w"))
    # words are dealt once, by document: their counts and the scores stay where they are
    freq = w.repartition("doc_id").withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "w")))
    score = freq.groupBy("doc_id", "k").agg(F.avg("n").alias("score"))
    ranked = s.join(score, ["doc_id", "k"]).withColumn("score", F.col("score") * F.when(F.length("s").between(45, 260), 1.15).otherwise(1.0))
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "k"))).where("r <= 6")
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ").alias("summary"))


@query("""
SELECT source, p_lang AS lang, doc_id FROM (SELECT source, lang AS p_lang, doc_id, row_number() OVER (PARTITION BY trim(lower(translate(text, 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc'))) ORDER BY doc_id) AS r FROM documents WHERE trim(lower(text)) <> '') WHERE r = 1""")
def fold_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each fold of a whole text; the fold moves as its digest."""
    f = T.tr_fold("text")
    p = read(spark, d, "documents").select("doc_id", "source", "lang", F.when(f != "", F.sha2(F.encode(f, "utf-8"), 256)).alias("k"))
    return dedup.first_of(p, F.col("k"), ["doc_id"]).select("source", "lang", "doc_id")


@query("""
WITH n AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS name, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)
SELECT p_partkey, pos, name FROM n WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(name) ORDER BY pos) = 1""")
def joint_names(spark: SparkSession, d: str) -> DataFrame:
    """Joint names cut apart, the first of each fold kept."""
    p = read(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "&").alias("names"))
    return dedup.split_names(p, "p_partkey", "names", F.lower).select("p_partkey", "pos", "name")


@query("""
WITH w AS (SELECT DISTINCT p_name AS n FROM part), t AS (SELECT n, string_split(n, ' ') AS t FROM w)
SELECT a, b, min(e) AS edits FROM (SELECT x.n AS a, y.n AS b, levenshtein(x.t[k], y.t[k]) AS e, k, list_filter(x.t, lambda v, i: i <> k) = list_filter(y.t, lambda v, i: i <> k) AS same FROM t x JOIN t y ON len(x.t) = len(y.t) AND x.n < y.n, range(1, 8) r(k) WHERE k <= len(x.t)) WHERE same AND e <= 2 GROUP BY 1, 2""")
def one_token_apart(spark: SparkSession, d: str) -> DataFrame:
    """Names of which one token differs slightly."""
    return dedup.one_token_apart(read(spark, d, "part"), "p_name").groupBy("a", "b").agg(F.min("edits").alias("edits"))


@query("""
WITH g AS (SELECT unnest(list_transform(range(1, length('^^' || lower(p_name) || '$') - 1), lambda k: substr('^^' || lower(p_name) || '$', k, 3))) AS gram FROM part)
SELECT gram, count(*) AS n, sum(count(*)) OVER (PARTITION BY substr(gram, 1, 2))::BIGINT AS total FROM g GROUP BY 1""")
def ngram_model(spark: SparkSession, d: str) -> DataFrame:
    """Counts of character trigrams and their contexts."""
    return measures.ngram_model(read(spark, d, "part"), "p_name").select("gram", "n", "total")


@query("""
WITH g AS (SELECT p_name, unnest(list_transform(range(1, length('^^' || lower(p_name) || '$') - 1), lambda k: substr('^^' || lower(p_name) || '$', k, 3))) AS gram FROM part),
m AS (SELECT gram, count(*) AS n FROM g GROUP BY 1), c AS (SELECT substr(gram, 1, 2) AS ctx, sum(n) AS total FROM m GROUP BY 1), q AS (SELECT DISTINCT p_name FROM part),
h AS (SELECT p_name, unnest(list_transform(range(1, length('^^' || lower(p_name) || '$') - 1), lambda k: substr('^^' || lower(p_name) || '$', k, 3))) AS gram FROM q)
SELECT p_name, round(avg(ln((n + 0.5) / (total + 15))), 6) AS score FROM h JOIN m USING (gram) JOIN c ON c.ctx = substr(gram, 1, 2) GROUP BY 1""")
def ngram_garble_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean log probability of a name's trigrams."""
    p = read(spark, d, "part").select("p_name")
    s = measures.ngram_score(p.distinct(), "p_name", measures.ngram_model(p, "p_name"))
    return s.select("p_name", F.round("score", 6).alias("score"))


@query("""
SELECT s_suppkey, levenshtein(s_name, 'Supplier#000000050') AS edits, round(levenshtein(s_name, 'Supplier#000000050') / 18.0, 6) AS cer FROM supplier""")
def char_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and character error rate."""
    ref = F.lit("Supplier#000000050")
    return read(spark, d, "supplier").select("s_suppkey", F.levenshtein("s_name", ref).alias("edits"), F.round(S.char_error_rate(ref, F.col("s_name")), 6).alias("cer"))


def turns_before(spark: SparkSession, d: str) -> DataFrame:
    """Turns (conv_id, turn, text) with the text of the one before (prev)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev is not null").select("conv_id", "turn", "prev", "text")


@query()
def word_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Token edit distance, alignment and overlap between neighbouring turns."""
    c = spread(turns_before(spark, d)).withColumn("m", S.compared_words("prev", "text"))
    a, b, hits = F.size(F.split("prev", " ")), F.size(F.split("text", " ")), F.col("m.common")
    p, r = hits / b, hits / a
    f1 = F.when(hits == 0, 0.0).otherwise(2 * p * r / (p + r))
    return c.select("conv_id", "turn", F.round(F.col("m.edits") / a, 6).alias("wer"), F.round(f1, 6).alias("f1"), F.col("m.matches").alias("matches"))


@query()
def name_matching(spark: SparkSession, d: str) -> DataFrame:
    """Rules and ratios of names."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = read(spark, d, "part").withColumn("other", F.lead("p_name").over(w)).where("other is not null")
    a, b = F.col("p_name"), F.col("other")
    return p.select("p_partkey", S.name_match(a, b).alias("match"), S.name_close(a, b).alias("close"), S.strict_close(a, b).alias("strict"), F.round(S.sequence_ratio(a, b), 6).alias("ratio"), F.round(S.jaro_winkler(a, b), 6).alias("jw"))


@query("""
SELECT doc_id, round(CASE WHEN n_chars = 0 THEN 0 ELSE greatest(0, least(1, exp(-(n_chars % 50) / 10.0))) END, 6) AS confidence FROM documents""")
def confidences(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities from log probabilities."""
    return read(spark, d, "documents").select("doc_id", F.round(S.confidence(-(F.col("n_chars") % 50) / 10.0), 6).alias("confidence"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE array_to_string(list_slice(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'drama' END, CASE WHEN doc_id % 3 = 0 THEN 'comedy' END, 'news'], lambda x: x IS NOT NULL), 1, 2), ' / ') END AS genres FROM documents""")
def genre_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first known labels of a delimited list."""
    i = F.col("doc_id")
    codes = F.when(i % 5 == 0, "zz").otherwise(F.concat_ws("|", F.when(i % 2 == 0, "q1"), F.lit("zz"), F.when(i % 3 == 0, "q2"), F.lit("q3")))
    return read(spark, d, "documents").select("doc_id", T.labels_of(codes, {"q1": "drama", "q2": "comedy", "q3": "news"}).alias("genres"))


@query("""
SELECT user_id, event_id, round((least(a + w, b + v) - greatest(a, b)) / (greatest(a + w, b + v) - least(a, b)), 6) AS iou FROM (SELECT user_id, event_id, value AS a, 50.0 AS w, 40.0 AS b, 30.0 AS v FROM events) WHERE least(a + w, b + v) > greatest(a, b)""")
def interval_iou(spark: SparkSession, d: str) -> DataFrame:
    """Intersection over union."""
    e = read(spark, d, "events")
    iou = S.time_iou(F.col("value"), F.col("value") + 50.0, F.lit(40.0), F.lit(70.0))
    return e.where(iou > 0).select("user_id", "event_id", F.round(iou, 6).alias("iou"))


@query()
def scripts_and_keys(spark: SparkSession, d: str) -> DataFrame:
    """Dominant script, cache keys, names without titles."""
    p = read(spark, d, "documents").select("doc_id", F.col("text").alias("t"), "lang")
    name = T.without_titles(F.concat(F.lit("Prof. Dr. "), F.col("t")), ["prof", "dr"])
    return p.select("doc_id", T.dominant_script("t").alias("script"), T.foreign_script("t").alias("foreign"), T.cache_key(F.col("t"), F.col("lang")).alias("key"), F.sha2(F.encode(name, "utf-8"), 256).alias("name"))


@query("""
WITH l AS (SELECT conv_id, turn, printf('[%02d:%02d:%02d] x', turn // 3600, (turn * 7) // 60 % 60, (turn * 7) % 60) AS line, ((turn * 7) // 60 % 60) * 60 + (turn * 7) % 60 + (turn // 3600) * 3600 AS s FROM conversations)
SELECT conv_id, s::DOUBLE AS s, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY s, turn), s + 3)::DOUBLE AS e FROM l""")
def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """Time-stamped lines to segments."""
    t = F.col("turn")
    line = F.format_string("[%02d:%02d:%02d] x", F.floor(t / 3600), F.floor(t * 7 / 60) % 60, t * 7 % 60)
    c = read(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))
    return files.transcript(c, "conv_id", "turn", "line").select("conv_id", "s", "e")


@query()
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """File names to columns and kinds."""
    n = read(spark, d, "part").select(F.concat(F.lit("2024-"), F.col("p_partkey").cast("string"), F.lit("-"), F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), (F.col("p_partkey") % 30).cast("string"))).otherwise(""), F.lit(".mp4")).alias("name"))
    return files.split_files(n, "name", F.col("name").endswith(".mp4"))
