"""Event logs in JSON lines: scans, newest-first reads, lookups, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SYSTEM_EVENT
from .tail import TailSource

LEAST, MOST = 1, 2000


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """All readable rows of current and rotated logs; broken lines are dropped."""
    return spark.read.schema(SYSTEM_EVENT).option("mode", "DROPMALFORMED").json(list(paths))


def select(events: DataFrame, limit: int | None = None, since: str | None = None, order: str = "ts", **equal: str | None) -> DataFrame:
    """Rows after since that equal each given value, newest first, at most limit of them (held within [1, 2000])."""
    d = events
    for k, v in equal.items():
        if v is not None:
            d = d.where(F.col(k) == v)
    if since is not None:
        d = d.where(F.col(order) > since)
    d = d.orderBy(F.desc(order), F.desc("event_id"))
    return d if limit is None else d.limit(max(LEAST, min(MOST, limit)))


def newest(spark: SparkSession, paths: str, limit: int, since: str | None = None, order: str = "ts", **equal: str | None) -> DataFrame:
    """``select`` over logs in order of time, read from their ends: more lines are asked for until enough of them fit, or there are no more.
    A log's lines are taken to be in order, so what is further back is older."""
    spark.dataSource.register(TailSource)
    limit = max(LEAST, min(MOST, limit))
    lines = 4 * limit
    while True:
        raw = spark.read.format("log_tail").option("path", paths).option("lines", lines).load()
        events = raw.select(F.from_json("line", SYSTEM_EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("e")).where("e.event_id IS NOT NULL").select("e.*")
        got = select(events, limit, since, order, **equal)
        if raw.count() < lines or got.count() >= limit:
            return got
        lines *= 8


def find(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id).orderBy(F.desc("ts")).limit(1)


def of_media(events: DataFrame, media_id: str) -> DataFrame:
    """A recording's events, oldest first."""
    return events.where(F.col("media_id") == media_id).orderBy("ts", "event_id")


def append(events: DataFrame, path: str) -> None:
    """Adds rows; Spark's commit keeps writers apart, so no lock is needed."""
    events.write.mode("append").json(path)


def put_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the store lacks; gives how many."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(rows.schema).json(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = rows.select(key).limit(0)
    new = rows.dropDuplicates([key]).join(known, key, "left_anti").persist()
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    new.unpersist()
    return n
