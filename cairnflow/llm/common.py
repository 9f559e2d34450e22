"""Shared pieces of the corpus operators: reading tables, intermediate tables in the shared folder, files in any store."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the one in spark.checkpoint.dir.  Where that is unset a local session gets
    one under its warehouse; on a cluster no folder is known to be shared, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(since: int = 0, until: int | None = None) -> None:
    """Drops the intermediate tables and files made since so many, the newest last, or those of them made before until."""
    for spark, path in _MADE[since:until]:
        try:
            drop_dir(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans it
            pass
    del _MADE[since:until]


def made() -> int:
    """How many intermediate tables and files there are."""
    return len(_MADE)


atexit.register(forget)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: it cuts lineage, survives lost executors, and gives the
    planner its true size, so that a later join is broadcast only if that size is under Spark's threshold."""
    path = fresh_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str):
    """(pyarrow file system, path in it) of a local path or a file:, hdfs:, s3: or gs: address."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path or uri
    return fs.FileSystem.from_uri(uri)


_C = ctypes.CDLL(None)  # glibc can give freed memory back
_HELD: dict[str, Callable[[], None]] = {}
_OWNER = ""


def hold(name: str, clear: Callable[[], None]) -> None:
    """Names a table that a worker process keeps between tasks, and how to empty it."""
    _HELD[name] = clear


def claim(name: str) -> None:
    """Empties what other operators keep in this worker process, so that a session's operators don't add up in its memory."""
    global _OWNER
    if _OWNER != name:
        for other, clear in _HELD.items():
            if other != name:
                clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(_C, "malloc_trim"):
            _C.malloc_trim(0)
        _OWNER = name


def quoted(name: str) -> str:
    """A column's name as Spark takes it literally, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batches(rows: Iterator, schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of row tuples."""
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)


def in_slices(parts: Iterator[pa.RecordBatch], rows: int = 1500) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of fewer rows, so that what is made of a batch stays small."""
    for b in parts:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)
