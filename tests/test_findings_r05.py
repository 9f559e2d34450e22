"""What the findings of round 5 name, on small inputs."""

from __future__ import annotations

import random

from cairnflow import catalogue, plans  # noqa: F401
from cairnflow.operators import nearness, relational


def test_blocks_without_a_near_pair(spark):
    """a task none of whose blocks have a near pair (before: an empty frame of doubles, and an error)."""
    d = [spark.createDataFrame([("x", t) for t in texts], "by string, t string") for texts in (["abcdef", "abcdeg"], ["uvwxyz", "nopqrs"])]
    assert nearness.similar_texts(*d, "t", 0.7, "by").collect() == []
    assert [(r.l, r.r) for r in nearness.similar_texts(d[0], d[0], "t", 0.8, "by").where("l < r").collect()] == [("abcdef", "abcdeg")]


def test_summaries_take_whole_texts(spark, tmp_path):
    """sentences between the head, middle and tail of a long text (before: cut out)."""
    code = lambda k: "".join(chr(97 + int(c)) for c in str(10_000 + k))
    other = [f"{code(k)}q {code(k)}w {code(k)}z {'-' * 60}." for k in range(900)]
    key = [f"Harbour lights harbour ships harbour number {'xi' * k}." for k in range(1, 7)]
    text = " ".join(other[:320] + key + other[320:])
    assert len(text) > 60_000 and 25_000 < text.index(key[0]) and text.index(key[-1]) < len(text) // 2 - 7_500
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.summary for r in catalogue.queries()["extractive_summary"](spark, str(tmp_path)).collect()] == [" ".join(key)]


def loop(rows, tolerance):
    """Rows (y, row, side, text) of one key, each with the first later one of the other side."""
    rows, out = sorted(rows), []
    while rows:
        y, _, side, text = rows.pop(0)
        k = next((k for k, x in enumerate(rows) if x[0] - y <= tolerance and x[2] != side), None)
        other = None if k is None else rows.pop(k)[3]
        out.append((text, other) if side == "l" else (other, text))
    return out


def test_every_line_takes_a_free_partner(spark, tmp_path):
    """rows of one side at one y each take a partner of the other side (before: the first alone)."""
    rng = random.Random(5)
    rows = [(doc, n, rng.choice([0.5, 1.0, 7.0]) * rng.randint(0, 30), rng.choice("lr"), f"t{n}") for n, doc in enumerate(rng.choices([1, 2, 3], k=300))]
    d = spark.createDataFrame(rows, "doc long, row long, y double, side string, text string")
    extra = spark.createDataFrame([(4, 1000, None, "l", "no place"), (None, 1001, 1.0, "r", "no doc")], d.schema)
    got = sorted(map(tuple, relational.line_partners(d.unionByName(extra), "doc", "y", 5.0).collect()), key=str)
    want = [(k, *p) for k in (1, 2, 3) for p in loop([r[2:3] + r[1:2] + r[3:] for r in rows if r[0] == k], 5.0)]
    assert got == sorted([*want, (4, "no place", None), (None, None, "no doc")], key=str)
    # six left and four right rows of a query's one place: four pairs
    part = [(200 * k, "Brand#11", 2 if k < 6 else 1, f"p{k}") for k in range(10)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_size long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.l, r.r) for r in catalogue.queries()["paired_lines"](spark, str(tmp_path)).collect()}
    assert got == {("p0", "p6"), ("p1", "p7"), ("p2", "p8"), ("p3", "p9"), ("p4", None), ("p5", None)}


def test_sets_are_written_once(spark, monkeypatch):
    """F8: whole sets are in one table, and those of candidates in another (before: once more for all representatives)."""
    from cairnflow.operators import dedup

    made, keep = {}, dedup.written
    monkeypatch.setattr(dedup, "written", lambda rows, what: made.setdefault(what, keep(rows, what)))
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    base = [rng.sample(words, 40) for _ in range(40)]
    sets = base + [rng.sample(base[0], 39) + ["other"], list(base[1])]
    d = spark.createDataFrame([("x" if k % 2 == 0 or k > 39 else "y", k, s) for k, s in enumerate(sets)] + [("y", 41, base[1][::-1])], "lang string, id long, w array<string>")
    got = {(r.a, r.b, round(r.similarity, 6)) for r in dedup.near_pairs(d, [d["lang"]], "id", "w", 0.85).collect()}
    assert got == {(0, 40, round(39 / 41, 6)), (1, 41, 1.0)}
    assert sorted(k for k, t in made.items() if "_i" in t.columns) == ["met", "sets"] and made["met"].count() == 2
