"""Logs read from their ends, and live sessions whose state ends by itself."""

import json
import random
import time

import pytest

from cairnflow.sources import logs, tail
from cairnflow.streaming import live


def line(k, kind="a"):
    return json.dumps({"event_id": str(k), "ts": f"2024-01-01 {k:08d}", "kind": kind}) + "\n"


@pytest.mark.parametrize("block", [7, 64, tail.BLOCK])
def test_the_end_of_a_file(tmp_path, block):
    rng = random.Random(1)
    for k, text in enumerate(["", "\n", "one", "one\n", "a\n\nb\n", "".join("x" * rng.randint(0, 30) + "\n" for _ in range(50)), "ü\n" * 20 + "no end"]):
        path = tmp_path / str(k)
        path.write_bytes(text.encode())
        lines = text.encode().split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        for n in (1, 2, 7, 1000):
            lo, hi, found = tail.newest_from(str(path), n, block)
            assert found == min(n, len(lines)) and hi == len(text.encode())
            assert [x for _, x in tail.lines_between(str(path), lo, hi, block)] == lines[max(0, len(lines) - n) :]
        cuts = sorted({0, len(text.encode()), *(rng.randint(0, len(text.encode())) for _ in range(5))})
        assert [x for a, b in zip(cuts, cuts[1:]) for _, x in tail.lines_between(str(path), a, b, block)] == (lines if text else [])


def test_newest_lines_of_rotated_logs(spark, tmp_path, monkeypatch):
    (tmp_path / "log.1").write_text("".join(line(k) for k in range(3000)))
    (tmp_path / "log").write_text("".join(line(k, "b" if k % 50 == 0 else "a") for k in range(3000, 6000)) + "{broken\n")
    spark.dataSource.register(tail.TailSource)
    paths = f"{tmp_path}/log,{tmp_path}/log.1,{tmp_path}/absent"
    got = spark.read.format("log_tail").option("path", paths).option("lines", 3100).load()
    assert got.count() == 3100 and got.where("file like '%log.1'").count() == 99
    assert [r.event_id for r in logs.newest(spark, paths, 3).collect()] == ["5999", "5998", "5997"]
    assert [r.event_id for r in logs.newest(spark, paths, 100, kind="b").collect()] == [str(k) for k in range(5950, 2999, -50)]
    assert logs.newest(spark, paths, 2000, since="2024-01-01 00005995").count() == 4
    read = []
    monkeypatch.setattr(tail, "_ranges", lambda p, lo, hi: read.append(hi - lo) or [tail.Range(p, lo, hi)])
    assert len(tail.TailReader({"path": paths, "lines": "10"}).partitions()) == 1 and read[0] < 1000  # not the file's other 190,000 bytes
    assert tail.TailReader({"path": str(tmp_path / "absent")}).partitions() == []


def test_a_stream_goes_on_after_restart_and_rotation(spark, tmp_path):
    log, old = tmp_path / "log", tmp_path / "log.1"
    spark.dataSource.register(tail.TailSource)

    def more():
        q = spark.readStream.format("log_tail").option("path", f"{log},{old}").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(json.loads(r.line)["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    log.write_text(line(1) + line(2) + line(3)[:-5])
    assert more() == ["1", "2"]
    with log.open("a") as f:
        f.write(line(3)[-5:] + line(4))
    log.rename(old)
    with old.open("a") as f:
        f.write(line(5))
    log.write_text(line(6))
    assert more() == ["1", "2", "3", "4", "5", "6"]
    assert more() == ["1", "2", "3", "4", "5", "6"]


def test_sessions_end_by_timer_and_their_state_goes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rules = live.LiveRules(resolve_after=1500, close_after=1500, pause_limit=1500, error_limit=1500, most_failures=1)
    schema = "session string, ts long, seq long, kind string"
    q = live.live_sessions(spark.readStream.schema(schema).json(str(tmp_path / "in")), rules).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()

    def put(name, *rows):
        (tmp_path / name).write_text("".join(json.dumps(dict(zip(("session", "ts", "seq", "kind"), r))) + "\n" for r in rows))
        (tmp_path / name).rename(tmp_path / "in" / name)

    def told(session):
        return [(r.event, r.mode, r.n) for r in spark.sql(f"SELECT * FROM live WHERE session = '{session}' ORDER BY at").collect()]

    def until(ok):
        end = time.time() + 90
        while not ok() and time.time() < end:
            time.sleep(0.3)
            assert q.exception() is None
        assert ok(), spark.sql("SELECT * FROM live").collect()

    try:
        put("a", ("talk", 1, 0, "start"), ("talk", 2, 0, "chunk"), ("talk", 3, 0, "chunk"), ("wait", 1, 0, "start"), ("wait", 2, 0, "pause"), ("wait", 3, 0, "chunk"), ("bad", 1, 0, "start"), ("bad", 2, 0, "error"), ("bad", 3, 0, "error"), ("done", 1, 0, "start"), ("done", 2, 0, "chunk"), ("done", 3, 0, "stop"), ("none", 1, 0, "chunk"))
        until(lambda: all(("status", "closed", n) in told(s) for s, n in (("talk", 2), ("wait", 0), ("bad", 0))))
        assert {"partial", "status", "final"} == {e for e, _, _ in told("talk")} and ("status", "resolving", 2) in told("talk")
        assert [e for e in told("bad") if e[0] == "dead"] == [("dead", "error", 0)]
        assert ("final", "listening", 1) in told("done") and ("status", "ready", 0) in told("done") and told("none") == []
        put("b", ("talk", 9, 0, "start"))
        until(lambda: told("talk").count(("status", "listening", 0)) == 2)
        until(lambda: told("talk").count(("status", "closed", 0)) == 1)
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    # no session is left in the state, only the counts of failures that still have time
    held = lambda v: spark.read.format("statestore").option("stateVarName", v).load(str(tmp_path / "cp"))
    assert held("now").count() == 0
    assert [r.key.session for r in held("failures").collect()] in ([], ["bad"])
    with pytest.raises(ValueError):
        live.live_sessions(spark.createDataFrame([], schema))
