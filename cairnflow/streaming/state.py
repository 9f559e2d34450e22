"""State folded over rows in order, as one function for tables and streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def stateful(rows: DataFrame, by: str, order: str, step: Step, schema: str, start: dict | None = None) -> DataFrame:
    """What step emits over each key's rows in order.  On a stream a key's state is kept as JSON between batches and rows are ordered
    within a batch; on a table all of a key's rows are one batch."""

    def fold(state: dict, pdf: pd.DataFrame) -> tuple[dict, list[dict]]:
        out = []
        for r in pdf.sort_values(order, kind="stable").to_dict("records"):
            state, events = step(state, r)
            out += events
        return state, out

    names = [c.split()[0] for c in schema.split(",")]
    if not rows.isStreaming:

        def table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{by: key[0]} | e for e in fold(dict(start or {}), pdf)[1]], columns=names)

        return rows.groupBy(by).applyInPandas(table, schema)

    def stream(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else dict(start or {})
        now, out = fold(now, pd.concat(list(pdfs)))
        state.update((json.dumps(now),))
        yield pd.DataFrame([{by: key[0]} | e for e in out], columns=names)

    return rows.groupBy(by).applyInPandasWithState(stream, schema, "state string", "append", "NoTimeout")


def session_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """A live session: ready, listening, paused; chunks that come while it is paused are dropped."""
    now = dict({"mode": "ready", "n": 0, "dropped": 0}, **state)
    kind, events = row["kind"], []
    if kind == "start":
        now["mode"] = "listening"
    elif kind == "pause" and now["mode"] == "listening":
        now["mode"] = "paused"
    elif kind == "resume" and now["mode"] == "paused":
        now["mode"] = "listening"
    elif kind == "error":
        now["mode"] = "error"
    elif kind == "chunk":
        if now["mode"] == "listening":
            now["n"] += 1
            events.append({"event": "partial", "n": now["n"], "mode": now["mode"]})
        else:
            now["dropped"] += 1
    elif kind == "stop":
        events.append({"event": "final", "n": now["n"], "mode": now["mode"]})
        now["mode"] = "ready"
    return now, events


def witness(ledger: DataFrame, new: DataFrame, key: str, digest: str, ts: str) -> DataFrame:
    """The ledger after new rows, and what each one did: NEW, SAME (its time is refreshed) or CONFLICT (the old one stays)."""
    n = new.select(key, F.col(digest).alias("_d"), F.col(ts).alias("_t"))
    j = ledger.join(n, key, "full")
    outcome = F.when(F.col("_d").isNull(), F.lit(None)).when(F.col(digest).isNull(), "NEW").when(F.col(digest) == F.col("_d"), "SAME").otherwise("CONFLICT")
    return j.withColumn("outcome", outcome).select(key, F.coalesce(digest, "_d").alias(digest), F.when(F.col("outcome").isin("NEW", "SAME"), F.col("_t")).otherwise(F.col(ts)).alias(ts), "outcome")


def counters(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Running count of each key, and whether it is past most."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("count", n).withColumn("dead", n > most)


def latest(history: DataFrame, key: str, version: list[str]) -> DataFrame:
    return history.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*version)).alias("r")).select("r.*")


def interrupted(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs left queued or running by a restart become interrupted; running it again changes nothing."""
    left = F.col("status").isin("queued", "running")
    return jobs.withColumns({"error": F.when(left, F.coalesce("error", F.lit("interrupted by restart"))).otherwise(F.col("error")), "completed_at": F.when(left, F.coalesce("completed_at", now)).otherwise(F.col("completed_at")), "status": F.when(left, "interrupted").otherwise(F.col("status"))})
