"""Tables that a plan writes and reads again, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def fresh(spark: SparkSession, what: str) -> str:
    """A new folder name under spark.checkpoint.dir (under the warehouse of a local session that has none); it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(rows: DataFrame, what: str) -> DataFrame:
    """rows as a table of that folder: the same rows for each reader, whatever executors are lost."""
    path = fresh(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@atexit.register
def _drop() -> None:
    for spark, path in _MADE:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            pass
