"""Cases of the findings of round 4, each of which failed before."""

import datetime as dt
import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd

from cairnflow import catalogue, plans  # noqa: F401
from cairnflow.functions import names as N
from cairnflow.operators import identity, nearness, relational, tracks


def test_velocities_as_sql_rounds_and_subtracts(spark, tmp_path):
    """Halves at the seventh digit, and times a few microseconds apart."""
    t0 = dt.datetime(2024, 1, 5, 3, 7, 11, 172425)
    data, t = [], t0
    for k in range(4000):
        t += dt.timedelta(microseconds=[64_000_000, 37, 1_280_000_000, 1_003][k % 4] + k % 13)
        data.append((k, t, k % 3, round(k * 7.13 % 97, 2)))
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT *, '' AS event_type FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(catalogue.oracle_sql()["velocities"]).fetchall())
    assert {r.event_id: r.velocity for r in catalogue.queries()["velocities"](spark, str(tmp_path)).collect()} == want


def test_role_fill_decides_ties(spark, tmp_path):
    """Lines of one place give the same roles however the table is dealt."""
    lines = [(o, 1, 100_007 + o * 7) for o in range(300)] + [(o, 2, 7 + o * 7) for o in range(300)] + [(o, 3, 1) for o in range(300)]
    parts = sorted({p for _, _, p in lines})
    spark.createDataFrame([(p, "hot bolt") for p in parts], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = []
    for name, rows in (("a", lines), ("b", lines[::-1])):
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        (tmp_path / name / "part.parquet").symlink_to(tmp_path / "part.parquet")
        got.append(sorted(tuple(r) for r in catalogue.queries()["role_fill"](spark, str(tmp_path / name)).collect()))
    assert got[0] == got[1]


def test_similar_texts_in_small_blocks_is_all_pairs(spark, monkeypatch):
    """A key of several blocks, texts over 64 letters, letters outside of the BMP and whole equal texts."""
    monkeypatch.setattr(nearness, "BLOCK", 8)
    rng = random.Random(5)
    syllables = ["tha", "ing", "he", "ou", "Re", "ñas", "\U0001f600", "ı", " "]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) for _ in range(70)] + ["abcdefgh" * 8, "abcdefgh" * 7 + "abcdxfgh", "abcdefgh" * 8 + "i", "z" * 300]
    d = spark.createDataFrame([(t, k % 2 if k < 60 else None) for k, t in enumerate(texts)], "t string, k int")
    for least in (0.5, 0.7, 0.86):
        want = {(x, y, SequenceMatcher(None, x, y).ratio()) for x in texts for y in texts}
        assert {tuple(r) for r in nearness.similar_texts(d, d, "t", least).collect()} == {w for w in want if w[2] >= least}
    by = {t: {k % 2 for k, u in enumerate(texts[:60]) if u == t} for t in texts}
    got = {(r.by, r.l, r.r) for r in nearness.similar_texts(d, d, "t", 0.7, "k").collect()}
    assert got == {(k, x, y) for x, y, q in want if q >= 0.7 for k in by[x] & by[y]}


def test_names_inside_in_small_groups_is_all_windows(spark, monkeypatch):
    """Several groups of names and lines, and windows that would lie over two lines."""
    monkeypatch.setattr(nearness, "NAMES", 2)
    monkeypatch.setattr(nearness, "LINES", 4)
    rng = random.Random(9)
    words = ["ali", "veli", "kaya", "mert", "demir", "öz", "the", "ing"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["xx ali", "kaya yy", "ali" * 40]
    who = ["ali kaya", "mert demir", "veli öz", "the ing the", "kayademir ali", "ali" * 30]
    d = [spark.createDataFrame([(t,) for t in x], f"{c} string") for x, c in ((lines, "line"), (who, "name"))]
    got = {(r.line, r.name) for r in nearness.names_inside(*d, "line", "name", 0.8).collect()}
    assert got == {(x, y) for x in lines for y in who if N.embedded(x, y, 0.8)}


def test_fused_lines_of_one_place_are_not_all_pairs(spark):
    """40,000 rows of either side at one y: 1.6 billion pairs, one of which is mutual."""
    d = spark.range(80_000).selectExpr("1 AS doc", "id AS row", "7.0D AS y", "IF(id % 2 = 0, 'l', 'r') AS side", "string(id) AS text")
    d = d.unionByName(spark.createDataFrame([(1, 90_000, 5.0, "r", "far"), (2, 1, 3.0, "l", "a"), (2, 2, 4.0, "r", "b"), (2, 3, 3.5, "r", "c"), (2, 0, 9.9, "l", "d")], d.schema))
    got = relational.fused_lines(d, "doc", "y", 5.0)
    assert [tuple(r) for r in got.where("l IS NOT NULL AND r IS NOT NULL").orderBy("doc").collect()] == [(1, "0", "1"), (2, "a", "c")]
    assert got.count() == 80_001 - 1 + 3


def test_a_hub_takes_no_round_for_each_of_its_pairs(spark, monkeypatch):
    """40 names near one, two of them met together: a fixed number of tables, and the clusters of the loop."""
    from cairnflow.operators import rounds

    made, keep = [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda rows, what: made.append(what) or keep(rows, what))
    rows = [("x", "hub", 0, 0)] + [("x", f"n{k}", min(k, 39), k) for k in range(1, 41)]
    d = spark.createDataFrame(rows, "by string, item string, mark long, pos long")
    pairs = spark.createDataFrame([("x", "hub", f"n{k}") for k in range(1, 41)], "by string, a string, b string")
    got = {r.item: r.cluster for r in rounds.vetoed_clusters(d, pairs).collect()}
    assert got == {"hub": 0} | {f"n{k}": 0 for k in range(1, 40)} | {"n40": 40}
    assert len(made) < 10
    # places and marks beyond what a double tells apart
    big = 1 << 60
    d = spark.createDataFrame([("x", "a", big, big), ("x", "b", big + 1, big + 1), ("x", "c", big + 1, big + 2)], "by string, item string, mark long, pos long")
    pairs = spark.createDataFrame([("x", p, q) for p, q in ("ab", "ac", "bc")], "by string, a string, b string")
    assert {r.item: r.cluster for r in rounds.vetoed_clusters(d, pairs).collect()} == {"a": big, "b": big, "c": big + 2}


def test_near_pairs_deal_prefixes_only(spark, monkeypatch):
    """what is dealt by item is a set's prefix, and few pairs that aren't near get as far as their sets; pairs are those of all pairs."""
    from cairnflow.operators import dedup

    made, keep = {}, dedup.written
    monkeypatch.setattr(dedup, "written", lambda rows, what: made.setdefault(what, keep(rows, what)))
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    base = [rng.sample(words, 40) for _ in range(30)]
    sets = base + [rng.sample(s, 38) + rng.sample(words, 2) for s in base] + [list(s) for s in base[:5]]
    got = {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, w array<string>"), [], "id", "w", 0.85).collect()}
    near = {(a, b) for b in range(60) for a in range(b) if len({*sets[a]} & {*sets[b]}) >= 0.85 * len({*sets[a]} | {*sets[b]})}
    assert got == near | {(k, 60 + k) for k in range(5)}
    assert made["prefixes"].count() <= 60 * 7
    assert made["candidates"].count() <= 2 * len(near)


def test_summaries_deal_words_once(spark, sf_dir):
    """of the shuffles of the plan one holds words (before: two, and a join by them)."""
    plan = catalogue.queries()["extractive_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("w#" in line for line in deals) and sum("doc_id" in line for line in deals) <= 4


def test_turns_are_compared_once_and_in_all_tasks(spark, sf_dir, monkeypatch):
    """one call of Python a pair (before: two, and all pairs of a small table in one task), and only runs come back."""
    from cairnflow.functions import similarity

    for name, call in (("word_error_rates", "compared_words"), ("phrase_differences", "lacking_runs")):
        plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and plan.count("ArrowEvalPython [") == 1 and call in plan
        assert "align_tokens" not in plan and "token_distance" not in plan
    rng = random.Random(2)
    for _ in range(300):
        k = rng.choice([1, 2, 3, 30, 100])
        a, b = ([str(rng.randrange(k)) for _ in range(rng.randint(0, 90))] for _ in "ab")
        want = similarity._by_rows(a, b)
        monkeypatch.setattr(similarity, "MOST_CELLS", 1 << 26)
        assert similarity.alignment(a, b) == want and similarity.edit_distance(a, b) == sum(op != "M" for op, _, _ in want)
        monkeypatch.setattr(similarity, "MOST_CELLS", -1)
        assert similarity.alignment(a, b) == want and similarity.alignment_ops(a, b) == [op for op, _, _ in want]


def test_runs_that_a_reading_lacks(spark):
    """numbers of runs, words and lengths as the whole alignment has them; nulls stay null."""
    from itertools import groupby

    from pyspark.sql import functions as F

    from cairnflow.functions import similarity

    rng = random.Random(8)
    rows = [tuple(" ".join(rng.choice(["a", "b", "c", "", "d"]) for _ in range(rng.randint(1, 20))) for _ in "ab") for _ in range(200)] + [(None, "a"), ("", "b")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.lacking_runs("a", "b").alias("r"), similarity.compared_words("a", "b").alias("m")).collect()
    for r in got:
        if r.a is None:
            assert r.r is None and r.m.edits is None
            continue
        whole = similarity.alignment(r.a.split(" "), r.b.split(" "))
        runs = [(g, op, [x or y if x is None else x for _, x, y in part]) for g, (op, part) in enumerate(((op, list(p)) for op, p in groupby(whole, lambda o: o[0])), 1)]
        assert [tuple(x) for x in r.r] == [(g, op, " ".join(w), len(w)) for g, op, w in runs if op in "ID"]
        assert r.m.matches == sum(op == "M" for op, _, _ in whole) and r.m.edits == len(whole) - r.m.matches


def test_keys_within_a_piece_take_no_scan(spark, monkeypatch):
    """states are carried on, a call of Python a key, for keys of several pieces only."""
    from cairnflow.operators import pieces

    def boom(pdf):
        raise AssertionError("a key of one piece was scanned")

    d = spark.range(3000).selectExpr("IF(id % 100 = 99, NULL, id % 100) AS key", "id AS pos", "IF(id % 7 < 3, 'x', 'y') AS label")
    want = {(r.key, r.nth, r.label, r["first"], r["last"], r.n) for r in pieces.fold_in_pieces(d, "key", ["pos"], pieces.regimes("u", 1), "label string, first long, last long, n long", 64).collect()}
    assert {k for k, *_ in want} == {None, *range(99)} and sum(w[5] for w in want) == 3000
    monkeypatch.setattr(pieces, "_scan", lambda machine: boom)
    got = pieces.fold_in_pieces(d.coalesce(1), "key", ["pos"], pieces.regimes("u", 1), "label string, first long, last long, n long", 1 << 14)
    assert {(r.key, r.nth, r.label, r["first"], r["last"], r.n) for r in got.collect()} == want


def test_names_are_folded_before_they_meet(spark):
    """No pair of names folds them again (before: each pair did, once a token)."""
    from pyspark.sql import functions as F

    from cairnflow.operators import credits, verdicts

    names = spark.createDataFrame([(1, 1, "Anna Karén"), (1, 2, "Bo Li Xu"), (1, 3, "Carla Monti"), (1, 4, None)], "doc long, pos long, name string")
    base = spark.createDataFrame([(1, 1, "Anna Karon"), (1, 2, "Monti, Carla"), (1, 3, None), (1, 5, "")], "doc long, pos long, name string")
    sources = base.select("doc", F.lit("a").alias("source"), "pos", "name", F.lit(True).alias("independent"))
    cast = credits.confirmed_cast(names, base, base, "doc")
    unsigned = credits.unsigned(names, base, base.limit(1), "doc", F.lit(True))
    unwitnessed = credits.unwitnessed(names.select("doc", "name"), base, "doc")
    for plan in (cast, unsigned, unwitnessed, verdicts.validated(names, sources, "doc")):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        met = [x for x in lines if "array_contains(" in x]
        assert met and not any("regexp_replace(" in x for x in met)
    assert {(r.name, r.source) for r in cast.collect()} == {("Anna Karon", "corrected"), ("Bo Li Xu", "dropped"), ("Carla Monti", "confirmed"), (None, "dropped"), (None, "filled"), ("", "filled")}
    assert {(r.name, r.suspect) for r in unsigned.collect()} == {("Anna Karén", True), ("Bo Li Xu", True), ("Carla Monti", False), (None, True)}
    assert {r.name for r in unwitnessed.collect()} == {"Bo Li Xu", None}


def test_readers_lines_are_folded_once_for_all_pairs(monkeypatch):
    """120 lines of two readers take a few folds each (before: one for each pair)."""
    from cairnflow.operators import readers

    calls, fold = [], N.fold
    monkeypatch.setattr(N, "fold", lambda s: (calls.append(s), fold(s))[1])
    readers._folded.cache_clear()
    rows = [{"reader": r, "text": f"line{k} of reader {k if r == 'a' else k + 60}"} for r in "ab" for k in range(60)]
    assert readers.merge_readers()(rows)
    assert len(calls) <= 10 * len(rows)


def _titles(spark, asked, forms):
    got = identity.search_titles(spark.createDataFrame(asked, "asked long, title string, year long"), spark.createDataFrame(forms, "work long, form string, year long, kind string"), "asked")
    return got


def test_search_titles_is_all_pairs(spark):
    """Against each title with each work, for forms within titles, titles within forms, works of several forms and years, and those that ask twice or without a year."""
    rng = random.Random(13)
    words = ["the", "there", "and", "sand", "house", "houses", "red", "redder", "of", "a"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((1, 1, 2, 2, 3))))
    forms = [(w, title() if rng.random() < 0.97 else "", rng.choice((None, 1950, 1951, 1953, 1957, 1980)), rng.choice(("movie", "tvSeries", "short", None))) for w in range(400) for _ in range(rng.choice((1, 1, 2, 3)))]
    asked = [(k, title(), rng.choice((None, 1950, 1952, 1990))) for k in range(120)] + [(k, title(), 1951) for k in range(8)] + [(130, None, 1950), (131, "", 1950), (132, "sand of sand", 1952), (133, "zzz", 1950)]
    rows = {}
    for w, f, y, k in forms:
        if f:
            rows.setdefault(w, []).append((f, y, k))
    points = {}
    for by, t, y0 in asked:
        if not t:
            continue
        long = [x for x in t.split(" ") if len(x) >= 4]
        key = max(long, key=len) if long else t
        for w, r in rows.items():
            if any(key in f for f, _, _ in r):
                fit = max(100 if f == t else 40 if t in f or f in t else 15 if key in f else 0 for f, _, _ in r)
                kind = max(identity.KINDS.get(k, 0) for _, _, k in r)
                apart = [abs(y - y0) for _, y, _ in r if y is not None and y0 is not None]
                near = [50 if a == 0 else 25 if a <= 2 else 8 if a <= 5 else -15 if a > 15 else None for a in apart]
                near = [n for n in near if n is not None]
                p = points.setdefault((by, w), [[], [], []])
                p[0].append(fit), p[1].append(kind), p[2].extend(near)
    score = {k: max(p[0]) + max(p[1]) + max(p[2], default=0) for k, p in points.items()}
    want = set()
    for by in {b for b, _, _ in asked}:
        best = sorted((-s, w) for (b, w), s in score.items() if b == by and s > 0)[:3]
        want |= {(by, w, -s, n) for n, (s, w) in enumerate(best, 1)}
    assert {tuple(r) for r in _titles(spark, asked, forms).collect()} == want


def test_search_titles_of_one_keyword_makes_no_pairs(spark, tmp_path, monkeypatch):
    """A keyword that all titles and works have: what is dealt and written grows with both, not with their product."""
    from pyspark.sql import DataFrame

    from cairnflow.sources import shared

    n, m = 1500, 3000
    asked = [(k, f"house {k:04}", 1950 + k % 9) for k in range(n)]
    forms = [(w, f"house y{w % 40}", 1950 + w % 7, "movie") for w in range(m)]
    made = []

    def counting(rows: DataFrame, what: str) -> DataFrame:
        out = shared.written(rows, what)
        made.append(out.count())
        return out

    monkeypatch.setattr(identity, "written", counting)
    assert _titles(spark, asked, forms).count() == 3 * n
    assert made and max(made) < 10 * (n + m)


def test_similar_texts_compares_a_pair_of_many_keys_once(monkeypatch):
    """Keys of a few equal texts: each pair's ratio is asked once, not once a key, and all keys get it."""
    texts = ["hot bolt", "hot volt", "hot colt", "cold bolts", "", "a" * 70, "a" * 66 + "bcd", "\U0001f600 bolt"]
    rows = pd.DataFrame([(k, texts, texts[: 2 + k % 7]) for k in range(300)], columns=["by", "a", "b"])
    want = sorted((k, a, b, 1.0 if a == b else SequenceMatcher(None, a, b).ratio()) for k in range(300) for a in texts for b in texts[: 2 + k % 7] if a and b and SequenceMatcher(None, a, b).ratio() >= 0.7)
    asked, ratio = [], SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: asked.append((self.a, self.b)) or ratio(self))
    got = [tuple(r) for d in nearness._near_in_blocks(0.7)(iter([rows])) for r in d[d["l"] != ""].itertuples(index=False, name=None)]
    assert sorted(got) == want
    assert len(asked) == len(set(asked))


def test_small_frames_score_as_arrays_do(monkeypatch):
    """Frames of few boxes are scored pair by pair, with the very numbers that the arrays give."""
    rng = random.Random(3)
    some = 0
    for _ in range(600):
        o = tracks.Open()
        for i in range(rng.randint(1, 6)):
            o.start(i, rng.randint(0, 8), np.array([rng.uniform(0, 300), rng.uniform(0, 300), rng.choice((9.0, 45.5, 120.0)), 18.0]), rng.choice(("click", "clock", "view", "")))
            if rng.random() < 0.6:
                o.see(i, 9, o.box[i] + np.array([rng.uniform(-3, 3), rng.uniform(-3, 3), 0, 0]), "clicks", 0.7)
        boxes = np.array([[rng.uniform(0, 300), rng.uniform(0, 300), 45.5, 18.0] for _ in range(rng.randint(1, 4))] + [o.box[0] + 1])
        args = (o, 10, boxes, [rng.choice(("click", "clock", "view", "clicks")) for _ in boxes], rng.choice((1.0, 1080.0)), tracks.TrackRules())
        monkeypatch.setattr(tracks, "FEW", 1 << 30)
        few = tracks.scores(*args)
        monkeypatch.setattr(tracks, "FEW", -1)
        assert np.array_equal(few, tracks.scores(*args))
        some += int((few > 0).sum())
    assert some > 100


def test_track_segments_are_dealt_to_all_tasks(spark, monkeypatch):
    """Small recordings don't come together in one task."""
    held, written = [], tracks.written

    def watch(rows, what):
        out = written(rows, what)
        if what == "tracked":
            held.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(tracks, "written", watch)
    rows = [(k, k * 10 + t, t, 1.0, 1.0, 9.0, 9.0, "one") for k in range(40) for t in range(5)]
    d = spark.createDataFrame(rows, "key long, row long, t long, x double, y double, w double, h double, text string")
    assert tracks.track_segments(d, "key").count() == 200
    assert held[0] == int(spark.conf.get("spark.sql.shuffle.partitions"))
