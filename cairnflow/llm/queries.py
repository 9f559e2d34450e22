"""The operators' queries over whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filteraudit, fm, hostrules, neardup, nndescent, ordermin, packing, pfp, piecesample, rangecoder, runs, tokencount, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placed pieces, and on each row the certificate: sequences in all, and those that any packing needs."""
    rows, report = packing.pack(table(spark, sf_dir, "documents"))
    return rows.withColumns({"n_sequences": F.lit(report["sequences"]).cast("long"), "bound": F.lit(report["bound"]).cast("long")})


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.report(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fm.score(docs, fm.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Short texts of whatever source as one host, most of whose documents fail.
SECTION = "CASE WHEN length(coalesce(text, '')) < 350 THEN 'short' ELSE source END"


def host_rules_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host rules with all short texts as a host of their own, which is rejected with those of its documents that pass."""
    d = table(spark, sf_dir, "documents").withColumn("section", F.expr(SECTION))
    return hostrules.judge(d, host="section").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.round_trip(table(spark, sf_dir, "documents"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: pieces, crc32 of their ids, and SHA-256 of what they decode to."""
    got = piecesample.decode(piecesample.encode(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.detect(table(spark, sf_dir, "documents"), edit=True))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filteraudit.failures(table(spark, sf_dir, "documents"))
    return filteraudit.audit(filteraudit.counters(failed, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_packing, op3_suffix_dedup, op4_near_dedup, op5_quality, op6_token_counts, op7_fingerprints, op8_host_rules, op9_token_ids, op10_piece_sampling, op11_periodic_runs, op12_near_vectors, op13_filter_audit, host_rules_by_section)}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha256(h) AS digest FROM p),
     f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)""",
    "op12_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
                     WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda c: coalesce(isfinite(c), false)), false) AND list_max(list_transform(embedding, lambda c: abs(c))) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
           WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
     r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
     c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id, least(vec_id, coalesce(c.c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
     w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM d),
     f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
                  100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w),
     l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
     m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
           FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
     one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
     o AS (SELECT a.s || b.s || c.s || d.s || e.s AS filter_order FROM one a, one b, one c, one d, one e
           WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
     k AS (SELECT filter_order, step::INT AS step, 1 << (strpos('ABCDE', filter_order[step]) - 1) AS bit,
                  coalesce((SELECT sum(1 << (strpos('ABCDE', filter_order[j]) - 1)) FROM (SELECT unnest(range(1, 6)) AS j) WHERE j < step), 0)::INT AS before
           FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, step, bit, sum(n * (mask & (bit | before) = 0)::INT) AS kept, sum(n * (mask & bit > 0 AND mask & before = 0)::INT) AS removed,
                  sum(n * (mask & bit > 0 AND mask & before > 0)::INT) AS redundant, sum(n * (mask = bit)::INT) AS unique_fails,
                  sum(n * good * (mask & bit > 0 AND mask & before = 0)::INT) AS good_lost, sum(n * toxic * (mask & bit > 0 AND mask & before = 0)::INT) AS toxic_lost
           FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r""",
}

_HOST_SQL = r"""
WITH t AS (SELECT doc_id, @host AS source, coalesce(text, '') AS x FROM documents),
     w AS (SELECT doc_id, source, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
     g AS (SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS tri
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
     r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) >= 2),
     c AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
     b AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                  len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
           FROM w LEFT JOIN c USING (doc_id)),
     j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
     h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM j GROUP BY source),
     m AS (SELECT sum(n) AS n, count(*) AS k, avg(f / n) AS mean0, var_samp(f / n) AS v, avg(1 / n) AS inv FROM h),
     m1 AS (SELECT *, least(greatest(mean0, 1 / (2.0 * n + 2)), 1 - 1 / (2.0 * n + 2)) AS mean FROM m),
     m2 AS (SELECT mean, CASE WHEN k < 2 THEN 20 WHEN v - mean * (1 - mean) * inv <= 0 THEN 1000
                              ELSE least(1000, greatest(1, mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1)) END AS weight FROM m1),
     p AS (SELECT source, (f + mean * weight) / (h.n + weight) AS r, h.n + weight AS size FROM h, m2),
     s AS (SELECT source, r - 1.645 * sqrt(r * (1 - r) / (size + 1)) >= 0.5 AS host_rejected FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept
FROM j JOIN s USING (source)"""
ORACLE_SQL["op8_host_rules"] = _HOST_SQL.replace("@host", "source")
ORACLE_SQL["host_rules_by_section"] = _HOST_SQL.replace("@host", SECTION)
