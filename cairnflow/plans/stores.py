"""Sources and sinks, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..sources import files, logs, sinks
from ..sources.shared import fresh
from .relational import read


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("media_id"), F.col("value").alias("duration_seconds"))


def event_log(spark: SparkSession, d: str) -> str:
    """The events as a log in JSON lines of two appends, the second with lines that can't be read."""
    e = event_rows(spark, d)
    path = fresh(spark, "log")
    logs.append(e.where("event_id % 2 = 0"), path)
    logs.append(e.where("event_id % 2 = 1"), path)
    e.where("event_id % 50 = 0").select(F.concat(F.lit("{broken "), "event_id").alias("value")).write.mode("append").text(path)
    return path


@query("""
SELECT event_id::VARCHAR AS event_id, event_type AS kind, user_id::VARCHAR AS media_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 500""")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """Newest rows of an appended log in JSON lines, broken lines left out."""
    return logs.select(logs.scan(spark, event_log(spark, d)), 500, kind="click").select("event_id", "kind", "media_id")


@query("""
SELECT event_id::VARCHAR AS event_id, event_type AS kind, user_id::VARCHAR AS media_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 300""")
def log_tail_backwards(spark: SparkSession, d: str) -> DataFrame:
    """The newest rows of a kind from the ends of a log and the files it was rotated to, without reading the rest."""
    path = fresh(spark, "rotated")
    e = event_rows(spark, d).repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
    e.write.json(path)
    return logs.newest(spark, path, 300, kind="purchase").select("event_id", "kind", "media_id")


@query("""
SELECT event_id::VARCHAR AS event_id, event_type AS kind, value AS duration_seconds FROM events WHERE event_id % 100 = 0""")
def log_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a log by id."""
    wanted = read(spark, d, "events").where("event_id % 100 = 0").select(F.col("event_id").cast("string").alias("event_id"))
    return logs.scan(spark, event_log(spark, d)).join(wanted, "event_id", "left_semi").select("event_id", "kind", "duration_seconds")


@query("""
SELECT doc_id, lang, sha256(text) AS sha FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL AND lang IS NOT NULL""")
def card_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON artifacts found by a pattern of folders, and looked up by content hash."""
    doc = read(spark, d, "documents").where("text is not null and lang is not null").select("doc_id", "lang", F.sha2(F.encode("text", "utf-8"), 256).alias("sha"))
    root = fresh(spark, "cards")
    for lang in ("de", "en", "es", "fr"):
        sinks.artifact(doc.where(F.col("lang") == lang), f"{root}/{lang}")
    wanted = doc.where("doc_id % 100 = 0").select("sha").distinct()
    cards = files.json_files(spark, f"{root}/*/*.json", "doc_id long, lang string, sha string", one_a_line=True)
    return cards.join(wanted, "sha", "left_semi").where("doc_id % 100 = 0").select("doc_id", "lang", "sha")


@query("""
SELECT DISTINCT upper(trim(p_name)) AS name FROM part""")
def csv_names(spark: SparkSession, d: str) -> DataFrame:
    """A table of scores in CSV, of which one column is read as a set of names."""
    path = fresh(spark, "scores")
    sinks.scores_csv(read(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_retailprice").alias("score"), "p_size"), path)
    return files.name_set(spark, path, "name")


@query("""
SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal < 0 THEN 'id,amount' WHEN s_suppkey % 3 = 0 THEN 'id' WHEN s_acctbal < 0 THEN 'amount' ELSE '' END AS errors FROM supplier""")
def manifest_items(spark: SparkSession, d: str) -> DataFrame:
    """A manifest's items, and those that fail a check by name."""
    path = fresh(spark, "manifest")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("amount"))
    # a file of items for each bucket of ids, as manifests come
    s.groupBy(F.crc32("id") % 16).agg(F.collect_list(F.struct("id", "amount")).alias("items")).select("items").write.json(path)
    good, bad = files.manifest(spark, path, "id string, amount double", {"id": F.col("id").cast("long") % 3 != 0, "amount": F.col("amount") >= 0}, one_a_line=True)
    return good.select("id", F.lit("").alias("errors")).unionByName(bad.select("id", F.array_join("errors", ",").alias("errors")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN 'large' WHEN l_discount > 0.08 THEN 'cheap' END AS drop_reason FROM lineitem""")
def audited_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept and rows dropped, with why, in two tables."""
    kept, dropped = fresh(spark, "kept"), fresh(spark, "dropped")
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    sinks.with_rejects(l, F.when(F.col("l_quantity") > 40, "large").when(F.col("l_discount") > 0.08, "cheap"), kept, dropped)
    return spark.read.parquet(kept).unionByName(spark.read.parquet(dropped), allowMissingColumns=True).select("l_orderkey", "l_linenumber", "l_partkey", "drop_reason")


@query("""
SELECT p_name AS k, CASE WHEN min(p_partkey % 2) = 0 THEN 'first' ELSE 'second' END AS v FROM part GROUP BY 1""")
def translate_cache(spark: SparkSession, d: str) -> DataFrame:
    """A store of keys and values that keeps what it has."""
    path = fresh(spark, "cache")
    p = read(spark, d, "part").select(F.col("p_name").alias("k"), "p_partkey")
    logs.put_new(p.where("p_partkey % 2 = 0").select("k", F.lit("first").alias("v")), path, "k")
    logs.put_new(p.select("k", F.lit("second").alias("v")), path, "k")
    return spark.read.schema("k string, v string").json(path)


@query("""
SELECT row_number() OVER (ORDER BY t, kind, id) AS event_no, kind, id FROM (SELECT o_orderdate AS t, 'card' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT ts, 'scroll', event_id FROM events)""")
def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of rows as one table with running numbers."""
    ts = lambda c: F.col(c).cast("timestamp").alias("t")
    cards = read(spark, d, "orders").select(ts("o_orderdate"), F.lit("card").alias("kind"), F.col("o_orderkey").alias("id"))
    return sinks.one_table(cards, read(spark, d, "events").select(ts("ts"), F.lit("scroll").alias("kind"), F.col("event_id").alias("id")), ["t", "kind", "id"]).select("event_no", "kind", "id")


@query("""
SELECT s_suppkey, s_name AS people, CASE WHEN s_suppkey % 3 = 0 THEN 'drama' WHEN s_suppkey % 3 = 1 THEN 'n' || s_nationkey END AS genre FROM supplier""")
def sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Values of nested properties of XML sidecars; a genre from the first property that has one, of a path its last part."""
    path = fresh(spark, "sidecars")
    prop = lambda name, v: F.concat(F.lit(f"<PROPERTY NAME='{name}'>"), v, F.lit("</PROPERTY>"))
    k = F.col("s_suppkey")
    genre = F.concat(prop("FORMAT", F.when(k % 3 == 0, "x/y/drama").otherwise("")), prop("CONTENT", F.when(k % 3 == 1, F.concat(F.lit("n"), "s_nationkey")).otherwise("")))
    read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("<BEAN><BEAN>"), prop("PERSON", F.col("s_name")), genre, F.lit("</BEAN></BEAN>")).alias("xml")).write.parquet(path)
    x = F.col("xml")
    return spark.read.parquet(path).select("s_suppkey", F.array_join(files.xml_values(x, "PERSON"), ",").alias("people"), files.xml_first(x, "FORMAT", "CONTENT").alias("genre"))


@query("""
SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS n FROM part""")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned table of which a second write replaces only the partitions that it has."""
    path = fresh(spark, "parts")
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    sinks.partitioned(p.withColumn("n", F.lit(0).cast("long")), path, "p_brand")
    sinks.partitioned(p.withColumn("n", F.count("*").over(Window.partitionBy("p_brand"))).where("p_brand < 'Brand#3'"), path, "p_brand")
    sinks.partitioned(p.withColumn("n", F.count("*").over(Window.partitionBy("p_brand"))).where("p_brand >= 'Brand#3'"), path, "p_brand")
    return spark.read.parquet(path).select("p_partkey", "n")
