"""Where results go: tables, audits of what was dropped, text scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def scores_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def artifact(rows: DataFrame, path: str) -> None:
    """A JSON artifact; Spark writes aside and renames on commit."""
    rows.write.mode("overwrite").json(path)


def partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces only the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def with_rejects(rows: DataFrame, reason: Column, kept: str, dropped: str) -> None:
    """Writes rows without a reason to kept, the others with it to dropped."""
    r = rows.withColumn("drop_reason", reason)
    r.where(F.col("drop_reason").isNull()).drop("drop_reason").write.mode("overwrite").parquet(kept)
    r.where(F.col("drop_reason").isNotNull()).write.mode("overwrite").parquet(dropped)


def one_table(first: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """Two kinds of rows as one table with running ids.  Rows are dealt by range, so that no task numbers them all, and written with
    their place in it before the ranges are counted: what is counted and what is numbered are the same rows."""
    both = first.unionByName(second, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(both.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = sorted((r["_p"], r["n"]) for r in local.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row a partition
    base, at = {}, 0
    for p, n in sizes:
        base[p], at = at, at + n
    offset = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("_p")] if base else F.lit(0)
    return local.withColumn("event_no", offset + (F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)) + 1).drop("_m", "_p")
