"""Sessions set up for large runs, and the SQL names of the library's functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans, so that partition counts, joins and skew follow the data's size at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("cairnflow")
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    register(spark)
    return spark


def register(spark: SparkSession) -> None:
    """Makes the similarity functions callable from SQL."""
    from .functions import similarity as s

    for name, f in {"jaro_winkler_similarity": s.jaro_winkler, "sequence_ratio": s.sequence_ratio, "token_distance": s.token_distance, "nfkd_ascii": s.nfkd_ascii}.items():
        spark.udf.register(name, f)
