"""Live sessions as a stream's state with timers: what is left alone ends by itself, and goes.

A session that gets no chunk for ``resolve_after`` is resolving: its text so far is final.  A resolving one ends ``close_after`` later, a paused one after ``pause_limit``, one
in error after ``error_limit``; a new start brings it back before that.  When a session ends its state is cleared, so the state is
as large as the sessions that are open.  Counts of failures by kind live as long as ``failures_ttl`` and go without a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class LiveRules:
    """Milliseconds."""

    resolve_after: int = 30_000
    close_after: int = 10_000
    pause_limit: int = 600_000
    error_limit: int = 60_000
    failures_ttl: int = 3_600_000
    most_failures: int = 3


OUT = "session string, event string, mode string, n long, at long"


class LiveSessions(StatefulProcessor):
    """Rows kind (start, chunk, pause, resume, error, stop) of a session to its events: status, partial, final, dead."""

    def __init__(self, rules: LiveRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "mode string, n long, due long")
        self.failures = handle.getMapState("failures", "kind string", "n int", ttlDurationMs=self.rules.failures_ttl)

    def _enter(self, mode: str, n: int, at: int) -> None:
        """The mode from now on, with the one timer that ends it; those set before are deleted."""
        wait = {"listening": self.rules.resolve_after, "resolving": self.rules.close_after, "paused": self.rules.pause_limit, "error": self.rules.error_limit}.get(mode)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = at + wait if wait is not None else 0
        if wait is not None:
            self.handle.registerTimer(due)
        self.now.update((mode, n, due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mode, n = ("ready", 0) if not self.now.exists() else tuple(self.now.get())[:2]
        out: list[tuple] = []
        at = timerValues.getCurrentProcessingTimeInMs()
        told = lambda event: out.append((key[0], event, mode, n, at))
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").to_dict("records"):
            kind, was = r["kind"], mode
            if kind == "start":
                mode, n = "listening", 0
            elif kind == "chunk" and mode in ("listening", "resolving"):
                mode, n = "listening", n + 1
                told("partial")
            elif kind == "pause" and mode in ("listening", "resolving"):
                mode = "paused"
            elif kind == "resume" and mode == "paused":
                mode = "listening"
            elif kind == "error":
                mode = "error"
                seen = self.failures.getValue(("error",))[0] + 1 if self.failures.containsKey(("error",)) else 1
                self.failures.updateValue(("error",), (seen,))
                if seen > self.rules.most_failures:
                    told("dead")
            elif kind == "stop" and mode != "ready":
                told("final")
                mode, n = "ready", 0
            if mode != was:
                told("status")
        if mode == "ready":
            self._forget()
        else:
            self._enter(mode, n, at)
        yield pd.DataFrame(out, columns=["session", "event", "mode", "n", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        at = timerValues.getCurrentProcessingTimeInMs()
        if self.now.exists():
            mode, n, due = self.now.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():  # else an older timer's
                if mode == "listening":
                    out.append((key[0], "status", "resolving", n, at))
                    self._enter("resolving", n, at)
                else:
                    out += [(key[0], "final", mode, n, at), (key[0], "status", "closed", n, at)]
                    self._forget()
        yield pd.DataFrame(out, columns=["session", "event", "mode", "n", "at"])

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.now.clear()

    def close(self) -> None:
        pass


def live_sessions(rows: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    """A stream of session, ts, seq and kind to the sessions' events.  It takes the RocksDB state store, which has timers and expiry."""
    if not rows.isStreaming:
        raise ValueError("timers need a stream; state.stateful folds a table")
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATES:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATES)
    return rows.select("session", "ts", "seq", "kind").groupBy("session").transformWithStateInPandas(LiveSessions(rules), OUT, "Append", "ProcessingTime")
