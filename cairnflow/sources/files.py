"""Files to rows: tables, JSON and YAML manifests, sidecars, transcripts, names."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tables(spark: SparkSession, folder: str, names: dict[str, str]) -> dict[str, DataFrame]:
    """Each table of a knowledge base by name; one that is missing is empty, with its schema."""
    out = {}
    for name, schema in names.items():
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = spark.createDataFrame([], schema)
        out[name].createOrReplaceTempView(name)
    return out


def name_set(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The distinct upper-case values of a CSV file's column; no other column is read."""
    return spark.read.option("header", True).csv(path).select(F.upper(F.trim(column)).alias("name")).where("name != ''").distinct()


def json_files(spark: SparkSession, pattern: str, schema: str, newest_first: bool = False, limit: int | None = None, one_a_line: bool = False) -> DataFrame:
    """A row for each JSON file of a pattern (for each of its lines with one_a_line), with its path and time of change."""
    d = spark.read.schema(schema).option("multiLine", not one_a_line).option("mode", "DROPMALFORMED").json(pattern).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))
    if newest_first:
        d = d.orderBy(F.desc("changed"), "path")
    return d.limit(limit) if limit is not None else d


def manifest(spark: SparkSession, path: str, item_schema: str, checks: dict[str, Column], one_a_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """The valid items of a manifest's list, and the others with the names of the checks that they fail."""
    d = spark.read.schema(f"items array<struct<{item_schema}>>").option("multiLine", not one_a_line).json(path).select(F.inline("items"))
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    d = d.withColumn("errors", bad)
    return d.where(F.size("errors") == 0).drop("errors"), d.where(F.size("errors") > 0)


def xml_values(xml: Column, name: str) -> Column:
    """The texts of all PROPERTY elements of a name."""
    return F.xpath(xml, F.lit(f"//PROPERTY[@NAME='{name}']/text()"))


def xml_first(xml: Column, *names: str) -> Column:
    """The first value of the first name that has one; of a path the last part."""
    return F.coalesce(*[F.element_at(F.split(F.when(F.size(xml_values(xml, n)) > 0, F.trim(F.get(xml_values(xml, n), F.lit(0)))), "/"), -1) for n in names])


def file_columns(name: Column) -> dict[str, Column]:
    """Id, title, profile and episode from a recording's file name: ID-TITLE-PROFILE-NNN.ext."""
    base = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    episode = F.regexp_extract(base, r"(?i)(?:_|-|\s)(?:b|bolum|ep)?(\d{1,4})$", 1)
    return {
        "file_id": F.regexp_extract(base, r"^([0-9]{4}-[0-9]+|[A-Z]{2,}[0-9]+)", 1),
        "title": F.trim(F.translate(F.regexp_replace(F.regexp_replace(base, r"^(?:[0-9]{4}-[0-9]+|[A-Z]{2,}[0-9]+)[-_ ]*", ""), r"(?i)[-_ ](?:b|bolum|ep)?\d{1,4}$", ""), "_", " ")),
        "episode": F.when(episode != "", episode.cast("int")),
        "profile": F.when(episode != "", "series").otherwise("film"),
    }


def split_files(names: DataFrame, name: str, known: Column) -> DataFrame:
    """Each file as episode, unidentified or skipped."""
    c = file_columns(F.col(name))
    kind = F.when(~known, "skipped").when(c["episode"].isNull(), "unidentified").otherwise("episode")
    return names.select(name, kind.alias("kind"), c["episode"].alias("episode")).orderBy("kind", "episode", name)


def transcript(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """Segments of [HH:MM:SS] lines: an end is the next start, the last one three seconds on."""
    t = F.regexp_extract(line, r"^\[(\d{2}):(\d{2}):(\d{2})\]\s*(.*)$", 1)
    part = lambda k: F.regexp_extract(line, r"^\[(\d{2}):(\d{2}):(\d{2})\]\s*(.*)$", k)
    d = lines.where(t != "").select(by, order, (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).cast("double").alias("s"), part(4).alias("text"))
    return d.withColumn("e", F.coalesce(F.lead("s").over(Window.partitionBy(by).orderBy("s", order)), F.col("s") + 3))


