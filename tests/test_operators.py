"""Operators against plain versions on small tables; queries against their SQL are checked in test_queries."""

import math
import random

import loops
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow import catalogue, plans, schemas  # noqa: F401
from cairnflow.functions import names, similarity, text
from cairnflow.operators import credits, decisions, dedup, folds, intervals, readers, relational, rosters, runs, tracks
from cairnflow.sources import files, logs, sinks
from cairnflow.streaming import state, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("f, s, want", [
    (text.tr_fold, " İSTANBUL Işık ", "istanbul isik"), (text.ascii_fold, "Ça-ğrı é!", "ca gri e"), (text.cast_fold, "Tarık  Şen,", "tarik sen"), (text.screen_text, "Ün 3-ı", "UN 3 I"),
    (text.tr_upper, "iğne ıЖ", "İĞNE I"), (text.quality_text, " Ünlü, mü? ", "unlu mu"), (text.plain_upper, " é  b ", "E B"), (text.upper_key, "Şık é", "SIK E")])
def test_folds(spark, f, s, want):
    assert one(spark, f(F.lit(s))) == want
    assert one(spark, f(F.lit(None).cast("string"))) == ""


def test_text_measures(spark):
    assert tuple(one(spark, text.longest_repeat(F.split(F.lit("a b b b c c"), " ")))) == (3, "b")
    assert one(spark, text.dominant_script(F.lit("abc где"))) == "cyrillic" and one(spark, text.dominant_script(F.lit("abc"))) == "latin"
    assert one(spark, text.foreign_script(F.lit("a漢"))) == "han"
    assert one(spark, text.snippet(F.lit("x" * 200 + "Needle" + "y" * 200), "needle", 3)) == "...xxxNeedleyyy..."
    assert one(spark, text.sentences(F.lit("Too short. This sentence is long enough to stay. No."))) == ["This sentence is long enough to stay."]
    assert one(spark, text.without_titles(F.lit("Prof. Dr. Ada Lovelace"), ["prof", "dr"])) == "Ada Lovelace"
    assert one(spark, text.without_titles(F.lit("Dr. Ada"), ["prof", "dr"])) == "Dr. Ada"


@pytest.mark.parametrize("a, b, match, close, strict", [
    ("Ada Lovelace", "Lovelace, Ada", True, False, False), ("Ada Lovelace", "Ada Lovelase", False, True, True), ("Ada", "Ada Byron", True, False, False), ("", "x", False, False, False),
    ("Ada Maria Byron", "Ada Byron", True, False, False), ("Ada Byron", "Ada Maria Byron", True, False, False)])
def test_names(spark, a, b, match, close, strict):
    a, b = F.lit(a), F.lit(b)
    assert one(spark, similarity.name_match(a, b)) == match
    assert one(spark, similarity.name_close(a, b)) == close
    assert one(spark, similarity.strict_close(a, b)) == strict


def test_similarities(spark):
    assert one(spark, F.round(similarity.jaro_winkler(F.lit("MARTHA"), F.lit("MARHTA")), 4)) == 0.9611
    assert similarity.edit_distance("kitten", "sitting") == 3
    assert [o for o, _, _ in similarity.alignment(["a", "b", "c"], ["a", "x", "c", "d"])] == ["M", "S", "M", "I"]
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, similarity.word_f1(words("a a b"), words("a b b"))) == pytest.approx(2 / 3)
    assert one(spark, similarity.box_iou(F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0))), F.array(*map(F.lit, (1.0, 0.0, 2.0, 2.0))))) == pytest.approx(1 / 3)
    assert one(spark, similarity.confidence(F.lit(float("nan")))) == 0.0 and one(spark, similarity.confidence(F.lit(5.0))) == 1.0


def spans(rng, n, top=100):
    return [(rng.randint(0, 2), float(s), float(s + rng.randint(0, 30))) for s in (rng.randint(0, top) for _ in range(n))]


def conversations(spark, path, texts):
    """The folder of a table with these turns of one conversation."""
    spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_turns_are_aligned_whole(spark, tmp_path):
    same = " ".join(f"w{k}" for k in range(100))
    d = conversations(spark, tmp_path, [same, f"{same} quite other words", same.replace("w70", "x")])
    got = {r.turn: (r.wer, r.matches) for r in catalogue.queries()["word_error_rates"](spark, d).collect()}
    assert got == {1: (0.03, 100), 2: (round(4 / 103, 6), 99)}
    assert [(r.turn, r.op, r.phrase, r.n) for r in catalogue.queries()["phrase_differences"](spark, d).collect()] == [(1, "I", "quite other words", 3), (2, "D", "quite other words", 3)]


def test_alignment_in_blocks_equals_full_table():
    def plain(a, b):
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
        out, i, j = [], len(a), len(b)
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                out.append("M" if a[i] == b[j] else "S")
            elif j and d[i][j] == d[i][j - 1] + 1:
                j -= 1
                out.append("I")
            else:
                i -= 1
                out.append("D")
        return d[-1][-1], out[::-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in "ab")
        assert (similarity.edit_distance(a, b), [o for o, _, _ in similarity.alignment(a, b)]) == plain(a, b)


def test_whole_texts_are_read(spark, tmp_path):
    """Texts that differ late only."""
    q = catalogue.queries()
    head = "word " * 80
    spark.createDataFrame([(1, head + "zebra one", "en"), (2, head + "приветы", "en"), (3, head + "directar", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    folds_ = q["other_folds"](spark, str(tmp_path)).where("doc_id != 2").collect()
    assert all(len({r[c] for r in folds_}) == 2 for c in ("upper_key", "quality", "plain", "tr_upper"))
    got = {r.doc_id: r for r in q["scripts_and_keys"](spark, str(tmp_path)).collect()}
    assert [(got[k].script, got[k].foreign) for k in (1, 2)] == [("latin", None), ("cyrillic", "cyrillic")]
    assert len({r.key for r in got.values()}) == len({r.name for r in got.values()}) == 3
    assert {r.doc_id: r.garbled for r in q["text_variants"](spark, str(tmp_path)).collect()} == {1: None, 2: None, 3: "role word"}
    rng = random.Random(2)
    late = [head[:200] + "".join(rng.choice(x) for _ in range(600)) for x in ("abcdefghi", "jklmnopqr")]
    d = conversations(spark, tmp_path, [late[0], late[0], late[1], late[1]])
    assert len({r.text for r in q["upper_prose"](spark, d).collect()}) == 2
    d = conversations(spark, tmp_path / "one_talk", [late[0], late[1], late[1]])
    assert sorted(r.row for r in q["recent_collapse"](spark, d).collect()) == ["1:0", "1:1"]
    assert {r.row: r.grp for r in q["text_groups"](spark, d).collect()} == {"1:0": 1, "1:1": 2, "1:2": 2}
    d = conversations(spark, tmp_path / "pairs", [late[0], late[1]])
    want = similarity.SequenceMatcher(None, late[1], late[0]).ratio()
    assert 0.2 <= want < 0.5 and [r.ratio for r in q["engine_agreement"](spark, d).collect()] == [round(want, 6)]


def test_bounded_ratio_equals_ratio():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcde ") for _ in range(rng.choice((0, 5, 30, 260)))) for _ in "ab")
        want = similarity.SequenceMatcher(None, a, b).ratio()
        assert all(similarity.ratio_from(a, b, least) == (want if want >= least else None) for least in (0.2, 0.5, 0.8, want))


@pytest.mark.parametrize("seed", range(3))
def test_overlap_joins(spark, seed):
    rng = random.Random(seed)
    left, right = [(k, *s) for k, s in enumerate(spans(rng, 25))], [(k, *s) for k, s in enumerate(spans(rng, 25))]
    a, b = spark.createDataFrame(left, "a int, m int, ls double, le double"), spark.createDataFrame(right, "b int, m int, rs double, re double")
    want = sorted((i, j) for i, m, s, e in left for j, n, t, f in right if m == n and s < f and t < e)
    for width in (7.0, 1000.0):
        assert sorted((r.a, r.b) for r in intervals.overlap_pairs(a, b, "m", width).collect()) == want
    touch = sorted((i, j) for i, m, s, e in left for j, n, t, f in right if m == n and s <= f and t <= e)
    assert sorted((r.a, r.b) for r in intervals.overlap_pairs(a, b, "m", 7.0, inclusive=True).collect()) == touch
    best = {r.a: r.b for r in intervals.best_overlap(a, b, "m", "a", ["b"], "b", 0.5, 9.0).collect()}
    for i, m, s, e in left:
        o = [(min(e, f) - max(s, t), -j) for j, n, t, f in right if m == n and s < f and t < e]
        top = max(o, default=(0, 0))
        assert best[i] == (-top[1] if e > s and top[0] / (e - s) >= 0.5 else None)


def covered(rows, m):
    out = set()
    for n, s, e in rows:
        if n == m:
            out |= set(range(int(s), int(e)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_coverage(spark, seed):
    rng = random.Random(seed)
    want, cover = spans(rng, 8), spans(rng, 8)
    w, c = spark.createDataFrame(want, "m int, s double, e double"), spark.createDataFrame(cover, "m int, s double, e double")
    got = [tuple(r) for r in intervals.uncovered(w, c, "m", width=11.0).collect()]
    for m in range(3):
        assert covered(got, m) == covered(want, m) - covered(cover, m)
    joined = [tuple(r)[:3] for r in intervals.coalesce(w, "m").collect()]
    assert all(covered(joined, m) == covered(want, m) for m in range(3))


def test_runs(spark):
    rows = [(1, p, v) for p, v in enumerate([0, 1, 1, 0, 1, 0, 0, 0, 1])] + [(2, 0, 0)]
    d = spark.createDataFrame(rows, "m int, pos int, v int")
    assert sorted(map(tuple, runs.true_runs(d, "m", "pos", F.col("v") == 1, 2, 2).collect())) == [(1, 1, 4, 3)]
    assert sorted(map(tuple, runs.longest_run(d, "m", "pos", F.col("v") == 1).collect())) == [(1, 2), (2, 0)]
    assert [r.pos for r in runs.evenly_spaced(d.where("m = 1"), "m", "pos", 3).orderBy("pos").collect()] == [0, 4, 8]


def test_folds_in_order():
    rows = [{"s": 0, "e": 5}, {"s": 6, "e": 9}, {"s": 9, "e": 30}, {"s": 90, "e": 91}]
    assert [(r["s"], r["e"]) for r in loops.capped_merge(10, 2)(rows)] == [(0, 9), (9, 30), (90, 91)]
    w = [{"s": k, "e": k + 1, "type": t, "metric": v} for k, (t, v) in enumerate([("A", 1), ("A", 3), ("A", 4), ("U", 0), ("A", 1)])]
    m = loops.merge_windows(0)(w)
    assert [(r["type"], r["metric"]) for r in m] == [("A", 3.0), ("U", 0), ("A", 1)]
    assert [(r["s"], r["e"]) for r in loops.smooth_bridges("U", 1)(m)] == [(0, 5)]
    assert [r["pos"] for r in loops.anchor_dedup(1, 1)([{"pos": k, "hash": h} for k, h in enumerate([0, 1, 2, 7, 7])])] == [0, 3]
    assert loops.onset("X", 0.5, "u", "m", 1, 2)([{"pos": k, "label": c, "confidence": 1} for k, c in enumerate("aaXXu")]) == [{"decision": "FOUND", "onset": 2}]
    assert loops.greedy_matching(0.8)([{"side": "c", "text": "abcde"}, {"side": "t", "text": "abcdf"}, {"side": "t", "text": "zzz"}])[0]["f1"] == pytest.approx(0.6667)
    assert [r["n"] for r in loops.variant_merge(0.8)([{"text": "maria", "n": 5}, {"text": "marla", "n": 1}, {"text": "bob", "n": 1}])] == [6, 1]


def test_spellings_seen_together_stay_apart():
    near = lambda a, b: a[:3] == b[:3]
    rows = [{"episode": e, "text": t} for e, t in [(1, "Anna"), (2, "Ann"), (3, "Anna"), (3, "Annb")]]
    got = {r["text"]: r["cluster"] for r in loops.spelling_clusters(near)(rows)}
    assert got["Anna"] == got["Ann"] != got["Annb"]


def test_spelling_clusters_by_name():
    rows = [(1, "Anna Karen"), (2, "Prof. Dr. Anna Karen"), (3, "Anna Karon"), (4, "Anna Karen"), (4, "Ana Karen"), (1, "Anna Karen"), (5, "Scott Paulin"), (6, "Pauline Chan"), (7, " "), (8, "Murat"), (9, "Murad")]
    got = {r["text"]: (r["cluster"], r["n"]) for r in loops.spelling_clusters()([{"episode": e, "text": t} for e, t in rows])}
    assert got == {"Anna Karen": (0, 2), "Prof. Dr. Anna Karen": (0, 1), "Anna Karon": (0, 1), "Ana Karen": (3, 1), "Scott Paulin": (4, 1), "Pauline Chan": (5, 1), "Murat": (6, 1), "Murad": (6, 1)}
    # the token index leaves out no pair that the test of all pairs finds
    import random

    rng = random.Random(4)
    parts = ["ann", "anna", "karen", "karon", "murat", "murad", "li", "de", "oz"]
    many = [{"episode": rng.randrange(30), "text": " ".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))} for _ in range(200)]
    assert loops.spelling_clusters()(many) == loops.spelling_clusters(lambda a, b: rosters.same_person(names.untitled(a), names.untitled(b)))(many)
    assert rosters.canonical({"B0b": 9, "Bob": 2, "Bobb": 2}) == "Bob" and rosters.canonical({"x": 1, "y": 1}, known=lambda s: s == "y") == "y"


def test_members_take_readings_one_to_one():
    got = rosters.match_members({"Ali Kaya": ["Aly Kaya"], "Ali Can Kaya": [], "Oz": []}, ["Ali Can Kaya", "Aly Kaya", "OZ", "Ali Kaya"])
    assert got == {"Ali Kaya": 3, "Ali Can Kaya": 0, "Oz": 2}


def test_roster_over_episodes():
    step, now, out = rosters.roster(), {}, []
    cast = [f"mem{k} ber{k}" for k in range(10)]
    read = [cast, cast[:9] + ["gue one"], cast[:2], [f"oth{k} err{k}" for k in range(5)], cast[:9] + ["gue one"], [*cast[:9], "gue one", ""], cast, {"source": "none"}, cast[:8] + [f"new{k} nam{k}" for k in range(13)]]
    for e, r in enumerate(read):
        now, events = step(now, {"episode": e, "members": r} if isinstance(r, list) else {"episode": e, "members": cast} | r)
        out += [(x["episode"], x["event"], x["member"]) for x in events]
    assert out == [(2, "EMPTY_READING", ""), (3, "FORMAT_BREAK", ""), (5, "DEPARTED", "mem9 ber9"), (5, "PROMOTED", "gue one"), (6, "RETURNED", "mem9 ber9"), (7, "EMPTY_READING", ""), (8, "NEW_NAMES", "13")]
    assert now["members"]["mem9 ber9"]["status"] == "ACTIVE"
    weak = {"members": {"a bcd": {"status": "WEAK", "spellings": {}, "episodes": [1], "missing": 0}, "e fgh": {"status": "ACTIVE", "spellings": {}, "episodes": [1], "missing": 0}}, "locked": 1}
    for e in range(2, 7):
        weak, events = step(weak, {"episode": e, "members": ["e fgh", "a bcd"] if e == 2 else ["e fgh"]})
    assert [(x["event"], x["member"]) for x in events] == [] and weak["members"]["a bcd"]["status"] == "DEPARTED"


def box(text, t, y, x=140.0, **more):
    return {"row": f"{text}{t}", "t": t, "x": x, "y": float(y), "w": 80.0, "h": 18.0, "text": text, "confidence": 0.9} | more


def test_tracks_follow_and_close():
    fold = tracks.track_boxes(height=360)
    of = lambda rows: {r["row"]: r["track"] for r in fold(rows)}
    fast = fold([box("JAMES", k, 40 + 26 * k) for k in range(6)])
    assert {r["track"] for r in fast} == {0} and fast[-1]["vy"] > 20  # no two boxes overlap
    assert fold([box("NOISE", k, 40, confidence=0.39) for k in range(6)]) == []
    assert set(of([box("JAMES", k, 80 + 12 * k) for k in (0, 1, 4, 5)]).values()) == {0}  # across a pause
    assert of([box("JAMES", k, 80) for k in (0, 1, 8)]) == {"JAMES0": 0, "JAMES1": 0, "JAMES8": 1}  # closed after five frames
    swap = of([box("ANDREA", k, 90) for k in range(3)] + [box("GERARD", k, 90) for k in range(3, 6)])
    assert {swap[f"ANDREA{k}"] for k in range(3)} == {0} and {swap[f"GERARD{k}"] for k in range(3, 6)} == {1}  # another text at the same place
    two = of([box(w, k, y) for k in range(4) for w, y in (("LEFT", 40 + 9 * k), ("RIGHT", 90 + 9 * k))])
    assert {two[f"LEFT{k}"] for k in range(4)} == {0} and {two[f"RIGHT{k}"] for k in range(4)} == {1}


def test_track_scores_by_hand():
    t = tracks.Open()
    t.start(0, 0, np.array([100.0, 50.0, 80.0, 20.0]), "ALPHA")
    got = tracks.scores(t, 2, np.array([[110.0, 60.0, 80.0, 20.0]]), ["ALPHB"], 360.0, tracks.TrackRules())[0, 0]
    place = 1 - math.hypot(10, 10) / (max(90, 5 + 160) + 80)
    shared = 70 * 10 / (2 * 1600 - 700)
    assert got == pytest.approx(0.40 * place + 0.32 * 0.8 + 0.18 * shared + 0.10 * 0.8)


def test_readers():
    merge = lambda a, b, **k: [(r["text"], r["source"]) for r in readers.merge_readers(**k)([{"reader": "a", "text": x} for x in a] + [{"reader": "b", "text": x} for x in b])]
    assert merge(["Yön", "Ali Velx", "Ayşe", "Son"], ["yon", "Ali Veli Can", "Ek", "Son"]) == [("Yön", "both"), ("Ali Velx", "a"), ("Ayşe", "a"), ("Ali Veli Can", "b"), ("Ek", "b"), ("Son", "both")]
    assert merge(["Mehmet Ozturl"], ["Mehmet Öztürk"]) == [("Mehmet Öztürk", "marks")]
    assert merge(["Mehmet Ozturl"], ["Mehmet Ozturk"], known={"mehmet ozturk": "Mehmet ÖZTÜRK"}) == [("Mehmet ÖZTÜRK", "known")]
    mode = lambda *x: readers.reading_mode()([{"text": t} for t in x])
    assert mode("MEHMET ALI", "MEHMET AL1", "MEHMET ALI", "XYZ") == [{"text": "MEHMET ALI", "confidence": 0.75, "n": 3}] and mode() == []
    groups = loops.spelling_groups()([{"text": t, "n": n} for t, n in [("Ali Velioglu", 5), ("Ali Velioğlu", 2), ("Ayse Kaya", 1), ("Ali Velioglx", 1)]])
    assert groups == [{"text": "Ali Velioğlu", "n": 8, "members": 3}, {"text": "Ayse Kaya", "n": 1, "members": 1}]
    row = lambda k, t, **m: {"row": k, "text": t, "n": 1, "confidence": 0.5, "frame": None, "y": 0.0, "h": 10.0} | m
    kept = readers.track_dedup()([row(0, "HEINZ"), row(1, "HEINZ BENNENT"), row(2, "GERARD DEPARDIEU"), row(3, "PARDIEU", n=9), row(4, "LIGHTS", frame=3), row(5, "SOUND", frame=3, y=5.0), row(6, "CAMERA", frame=3, y=30.0)])
    assert [r["row"] for r in kept] == [1, 3, 4, 6]


def test_names_inside_lines():
    assert names.embedded("BAKKAL / THE GROCER ZÜLTİKAR GÜRLEK", "Zülfikar Gürlek") and not names.embedded("THE GROCER", "Zülfikar Gürlek")
    assert names.embedded("vahapefe", "Vahap Efe") and not names.embedded("abc", "abc") and not names.embedded(None, "Vahap Efe")
    assert names.whole_words("HEINZ", "Heinz Bennent") and not names.whole_words("HEIN", "Heinz Bennent")
    assert names.suffix_token("PARDIEU", "GERARD DEPARDIEU") and not names.suffix_token("NOT", "GERARD DEPARDIEU") and names.suffix_token("BENNENT", "HEINZ BENNENX") and not names.suffix_token("Z BENNENT", "HEINZ BENNENX")
    assert names.untitled("OP.DR. Ali Kaya") == "Ali Kaya" and names.untitled("Dr. Kaya") == "Dr. Kaya"
    for a, b in [("Scott Paulin", "Pauline Chan"), ("Kavi Raz", "Micaella Raz")]:
        assert not names.matches(a, b)
    assert names.close("Murat Cimcir", "Murat Cemcir") and not names.close("Ali Kay", "Ali Kar") and names.matches("Ali Can Kaya", "Ali Kaya Can")


def test_relational(spark):
    a = spark.createDataFrame([("cat",), ("dog",), ("",)], "l string")
    b = spark.createDataFrame([("cut",), ("dogs",), ("cats",), ("x",)], "r string")
    assert sorted((r.l, r.r) for r in relational.one_edit_join(a, b, "l", "r").collect()) == [("", "x"), ("cat", "cats"), ("cat", "cut"), ("dog", "dogs")]
    n = spark.createDataFrame([("J. Smith",), ("Ada",)], "l string")
    k = spark.createDataFrame([("John Smith",), ("Ada Byron",), ("Ada King",)], "r string")
    assert [tuple(r) for r in relational.unique_containment(n, k, "l", "r").collect()] == [("J. Smith", "John Smith")]
    lines = spark.createDataFrame([(1, 0, 10.0, "l", "Director"), (1, 1, 12.0, "r", "Ada"), (1, 2, 50.0, "l", "Cast")], "m int, row int, y double, side string, text string")
    assert sorted(((r.l, r.r) for r in relational.fused_lines(lines, "m", "y", 5.0).collect()), key=str) == [("Cast", None), ("Director", "Ada")]


def test_short_needles_are_found_inside_words(spark):
    t = spark.createDataFrame([(1, "Alpine lake"), (2, "royal"), (3, "al"), (4, "stone"), (5, "a lens")], "k long, name string")
    q = spark.createDataFrame([("al",), ("e",), ("in",), ("lake",)], "needle string")
    got = relational.two_pass(q, t, "needle", "name", "k")
    assert sorted((r.needle, r.k, r["pass"]) for r in got.collect()) == [("al", 1, 2), ("al", 2, 2), ("al", 3, 1), ("e", 1, 2), ("e", 4, 2), ("e", 5, 2), ("in", 1, 2), ("lake", 1, 2)]


def test_dedup(spark):
    rng = random.Random(1)
    sets = [[rng.choice("abcdefgh") for _ in range(6)] for _ in range(40)]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id int, w array<string>")
    first = [next(i for i, t in enumerate(sets) if {*t} == {*s}) for s in sets]
    want = [(i, j) for j in range(40) for i in range(j) if first[i] == i and first[j] == j and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.7]
    want += [(i, j) for j, i in enumerate(first) if i != j]
    assert sorted((r.a, r.b) for r in dedup.near_pairs(d, [], "id", "w", 0.7).collect()) == sorted(want) and len(set(first)) < 40
    same = spark.range(3000).select("id", F.array(F.lit("x"), F.lit("y")).alias("w"))
    assert dedup.near_pairs(same, [], "id", "w", 0.7).count() == 2999  # not all pairs
    h = [rng.getrandbits(63) for _ in range(5)]
    h += [x ^ 5 for x in h]
    g = dedup.hamming_pairs(spark.createDataFrame(list(enumerate(h)), "id int, bits long"), "id", "bits", 3)
    assert sorted((r.a, r.b, r.bits) for r in g.collect()) == [(k, k + 5, 2) for k in range(5)]


def test_cascade(spark):
    rows = [("...", 0.0, 0.0, "tr"), ("thanks for watching", 0.0, 0.0, "tr"), ("привет всем тут", 0.0, 0.0, None), ("привет", 0.0, 0.0, "ru"), ("la " * 25, 0.0, 0.0, "tr"), ("x" * 90, 0.0, 0.0, "en"), ("bir iki", 0.0, -1.2, "tr"), ("fine words here", 0.5, -0.9, "de")]
    got = decisions.judge_segments(spark.createDataFrame(rows, "text string, no_speech double, logprob double, language string")).collect()
    assert [(r.drop_reason or "").split(":")[0] for r in got] == ["no_alnum", "stock_artifact", "foreign_script_artifact", "", "repetition_collapse", "long_token_artifact", "very_low_logprob_short_text", ""]
    assert got[7].flags == ["high_no_speech_prob", "low_logprob", "unexpected_language", "low_confidence"]


def test_records(spark):
    r = spark.createDataFrame([(0.9, None), (0.9, ["e"]), (2.0, [])], "confidence double, evidence_ids array<string>").select(schemas.relation_errors().alias("e")).collect()
    assert [x.e for x in r] == [["evidence_ids"], [], ["confidence", "evidence_ids"]]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [{"event_id": str(k), "ts": f"2024-01-0{k}", "kind": "a" if k % 2 else "b"} for k in range(1, 6)]
    d = spark.createDataFrame([tuple(r.values()) for r in rows], "event_id string, ts string, kind string")
    logs.append(d, path)
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    e = logs.scan(spark, path)
    assert [r.event_id for r in logs.select(e, 0, kind="a").collect()] == ["5"]
    assert [r.event_id for r in logs.select(e, 5000, since="2024-01-03").collect()] == ["5", "4"]
    assert logs.find(e, "2").first().ts == "2024-01-02"
    kv = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert logs.put_new(kv, str(tmp_path / "kv"), "k") == 2 and logs.put_new(kv, str(tmp_path / "kv"), "k") == 0


def test_files(spark, tmp_path):
    x = F.lit("<R><PROPERTY NAME='A'></PROPERTY><PROPERTY NAME='B'>x/drama</PROPERTY></R>")
    assert one(spark, files.xml_first(x, "A", "B")) == "drama"
    c = files.file_columns(F.lit("2024-17-My_Show-12.mp4"))
    assert [one(spark, c[k]) for k in ("file_id", "title", "episode", "profile")] == ["2024-17", "My Show", 12, "series"]
    got = files.tables(spark, str(tmp_path), {"titles": "tconst string, year int"})["titles"]
    assert got.columns == ["tconst", "year"] and got.count() == 0
    lines = spark.createDataFrame([(1, 0, "[00:00:05] a"), (1, 1, "noise"), (1, 2, "[00:01:00] b")], "m int, k int, line string")
    assert [(r.s, r.e) for r in files.transcript(lines, "m", "k", "line").orderBy("s").collect()] == [(5.0, 60.0), (60.0, 63.0)]
    (tmp_path / "m.json").write_text('{"items": [{"id": "a", "n": 1}, {"id": null, "n": 2}]}')
    good, bad = files.manifest(spark, str(tmp_path / "m.json"), "id: string, n: int", {"id": F.col("id").isNotNull()})
    assert good.count() == 1 and bad.first().errors == ["id"]
    both = sinks.one_table(spark.createDataFrame([(3, "a"), (1, "b")], "t int, x string"), spark.createDataFrame([(2, "c")], "t int, x string"), ["t"])
    assert sorted((r.event_no, r.t) for r in both.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_state(spark):
    s = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "k string, d string, t int")
    n = spark.createDataFrame([("a", "x", 2), ("b", "z", 2), ("c", "n", 2)], "k string, d string, t int")
    assert sorted(map(tuple, state.witness(s, n, "k", "d", "t").collect())) == [("a", "x", 2, "SAME"), ("b", "y", 1, "CONFLICT"), ("c", "n", 2, "NEW")]


def test_stream_equals_table(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", "chunk" if m % 5 else "start") for m in range(20)] + [(2, "2024-01-01 00:30:00", "stop")]
    d = spark.createDataFrame(rows, "u long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    schema = "u long, event string, n long, mode string"
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    got = run(state.stateful(stream, "u", "ts", state.session_step, schema), "live", "append")
    assert got == sorted(map(tuple, state.stateful(d, "u", "ts", state.session_step, schema).collect()))
    count = F.count("*").alias("n")
    assert run(windows.tumbling(stream, "ts", "10 minutes", ["kind"], count), "tumble", "complete") == sorted(map(tuple, windows.tumbling(d, "ts", "10 minutes", ["kind"], count).collect()))


def test_credits(spark):
    lines = ["Intro words", "Director", "Ada Byron", "Grace Hopper", "Cast", "Alan Turing & Kurt Godel", "alan turing", "Guest Stars", "Emmy Noether", "Producer: x", "studio film"]
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc int, pos int, line string")
    got = sorted((r.role, r["rank"], r.name) for r in credits.parsed_credits(d, "doc", "pos", "line").collect())
    assert got == [("cast", 1, "Alan Turing"), ("cast", 2, "Kurt Godel"), ("cast", 3, "Emmy Noether"), ("director", 1, "Ada Byron"), ("director", 2, "Grace Hopper")]
    assert [r.name for r in credits.guests(d, "doc", "pos", "line").collect()] == ["Emmy Noether"]
    roles = {(r.role, r.name) for r in credits.anchored_roles(d, "doc", "pos", "line").collect()}
    assert {("director", "Ada Byron"), ("director", "Grace Hopper")} <= roles
    block = ["keep", "this series", "a", "was made", "also", "end of part 7", "kept"]
    b = spark.createDataFrame([(1, k, x) for k, x in enumerate(block)], "doc int, pos int, line string")
    out = credits.stop_cards(b, "doc", "pos", "line", "this series", "was made", r"^end of part (\d+)$").orderBy("pos").collect()
    assert [r.line for r in out] == ["keep", "also", "kept"] and out[0].card_no == 7
    assert [bool(one(spark, credits.valid_person(F.lit(n)))) for n in ("Ada Byron", "Ada", "J. Smith", "Ada 3", "Film Studio Co")] == [True, False, True, False, False]


def test_confirmed_cast(spark):
    t = "doc int, pos int, name string"
    read = spark.createDataFrame([(1, 0, "Ada Byron"), (1, 1, "Grase Hopper"), (1, 2, "Noise Words"), (1, 3, "Emmy Noether")], t)
    known = spark.createDataFrame([(1, 0, "Grace Hopper"), (1, 1, "Ada Byron"), (1, 2, "Alan Turing")], t)
    seen = spark.createDataFrame([(1, 0, "Emmy Noether")], t)
    got = sorted((r["rank"] or 0, r.name, r.source) for r in credits.confirmed_cast(read, known, seen, "doc").collect())
    assert got == [(0, "Noise Words", "dropped"), (1, "Ada Byron", "confirmed"), (2, "Grace Hopper", "corrected"), (3, "Emmy Noether", "second"), (4, "Alan Turing", "filled")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, k string")
    sinks.with_rejects(d, F.when(F.col("id") == 2, "odd"), str(tmp_path / "kept"), str(tmp_path / "dropped"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2 and spark.read.parquet(str(tmp_path / "dropped")).first().drop_reason == "odd"
    sinks.partitioned(d, str(tmp_path / "p"), "k")
    sinks.partitioned(d.where("k = 'b'").withColumn("id", F.lit(9)), str(tmp_path / "p"), "k")
    assert sorted((r.id, r.k) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "a"), (3, "a"), (9, "b")]
    sinks.scores_csv(d, str(tmp_path / "csv"))
    assert files.name_set(spark, str(tmp_path / "csv"), "k").count() == 2
    sinks.artifact(d.limit(1), str(tmp_path / "json"))
    assert files.json_files(spark, str(tmp_path / "json"), "id int, k string", newest_first=True, limit=5).first().k == "a"


def test_more_folds():
    rows = [{"row": k, "text": t, "confidence": c} for k, (t, c) in enumerate([("anna smith", 0.5), ("anna smitt", 0.9), ("ann smitt", 0.1), ("bob", 0.3), ("anna smit", 0.2)])]
    assert [r["row"] for r in loops.transitive_clusters(0.85)(rows)] == [1, 3]
    rows = [{"row": k, "text": t, "evidence": e, "known": n} for k, (t, e, n) in enumerate([("ada byron", 2, False), ("ada byrom", 0, False), ("eve low", 1, False), ("eve lowe", 3, False), ("max x", 1, True), ("max y", 2, False)])]
    assert [r["row"] for r in loops.clone_collapse(0.75)(rows)] == [0, 3, 4, 5]
    assert [r["n"] for r in loops.overlap_groups(0.5)([{"s": 0, "e": 4}, {"s": 2, "e": 6}, {"s": 9, "e": 9}])] == [2, 1]
    assert [r["e"] for r in folds.budgeted_prefix(2, 5, 8)([{"s": 0, "e": 9}, {"s": 10, "e": 19}, {"s": 20, "e": 29}])] == [5, 13]
    assert [r["row"] for r in folds.recent_collapse(0.9, 1)([{"row": k, "text": t} for k, t in enumerate(["abcdefghij", "abcdefghik", "zz", "abcdefghij", "zz"])])] == [0, 2]
    assert [r["grp"] for r in folds.temporal_groups(0.8, 2, 10)([{"row": k, "text": t, "t": s, "x": 0, "y": 0} for k, (t, s) in enumerate([("HELLO", 0), ("HELLO", 1), ("WORLD", 1), ("HELLO", 9)])])] == [1, 1, 2, 3]
    assert loops.merged_chunks(100.0, 10.0, 30.0, 1.0, 0.0)([{"s": 20, "e": 22}, {"s": 40, "e": 60}])[0] == {"chunk": 0, "s": 16.0, "e": 26.0, "n": 1}


def test_registered_functions(spark):
    assert spark.sql("SELECT jaro_winkler_similarity('a', 'a') x, sequence_ratio('ab', 'ab') y, nfkd_ascii('éı') z, token_distance(array('a'), array('b')) d").first() == (1.0, 1.0, "ei", 1)


def test_segments(spark):
    cases = [  # text, no_speech, logprob, language, reason, flags
        ("하루 날 써잇", 0.0, -0.2, "tr", "foreign_script_artifact:hangul", ["foreign_script_artifact"]),
        ("Tchau, lugar.", 0.0, -0.2, "tr", "short_foreign_phrase_artifact:tchau lugar", ["foreign_phrase_artifact"]),
        ("I got time.", 0.0, -0.2, "en", None, []),
        ("I got time.", 0.0, -0.2, None, "short_foreign_phrase_artifact:i got time", ["foreign_phrase_artifact"]),
        ("İzlediğiniz için teşekkür ederim", 0.1, -0.3, "tr", "stock_artifact:izlediğiniz için teşekkür ederim", ["stock_artifact"]),
        ("Altyazı M.K.", 0.1, -0.2, "tr", "stock_artifact:altyazı m.k.", ["stock_artifact"]),
        ("Evet ben söyledim", 0.7, -0.4, "tr", None, ["high_no_speech_prob", "low_confidence"]),
        ("É", 0.8, -1.1, "tr", "multi_signal_low_quality", []),
        ("É", 0.8, -1.5, "tr", "very_low_logprob_short_text", ["very_low_logprob"]),
        ("çıplak " * 54, 0.1, -0.2, "tr", "repetition_collapse:çıplak:run=54", ["repetition_collapse"]),
        ("Evet, " + "ÇIplak! çıplak " * 10 + "hayır", 0.1, -0.2, "tr", "repetition_collapse:ÇIplak!:run=20", ["repetition_collapse"]),
        ("a b " * 30, 0.1, -0.2, "tr", None, []),
        (". " * 25 + "x", 0.1, -0.2, "tr", "repetition_collapse:.:run=25", ["repetition_collapse"]),
        (". ! " * 25 + "x", 0.1, -0.2, "tr", None, []),
        ("Normal cümle " + "Hıhı" * 60 + " devam", 0.1, -0.2, "tr", "long_token_artifact:length=240", ["long_token_artifact"]),
        ("Ayy, de finiske öğret.", 0.0, -1.29, "tr", "very_low_logprob_short_text", ["very_low_logprob"]),
        ("Bu cümle biraz düşük güvenli ama uzun olduğu için kalsın", 0.0, -1.16, "tr", None, ["low_logprob", "low_confidence"]),
        ("Tüm hazırlıklar tamamlandı", 0.05, -0.2, "tr", None, []),
        ("Bonjour tout le monde", 0.05, -0.2, "fr", None, ["unexpected_language", "low_confidence"]),
        ("... !", 0.0, 0.0, "tr", "no_alnum", []), (None, 0.0, 0.0, "tr", "no_alnum", []),
    ]
    d = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, text string, no_speech double, logprob double, language string")
    got = {r.k: r for r in decisions.judge_segments(d).collect()}
    assert [(got[k].drop_reason, got[k].flags, got[k].keep) for k in range(len(cases))] == [(c[4], c[5], c[4] is None) for c in cases]
    only = decisions.judge_segments(d.where("k = 5"), decisions.SegmentRules(drop_stock=False)).first()
    assert only.keep and only.flags == ["stock_artifact", "low_confidence"]
    assert len(decisions.STOCK_PHRASES) == 31


@pytest.mark.parametrize("name, ok", [
    ("Jean-Dominique de la Rochefoucauld", True), ("E. B. Clucher", True), ("John B. Smith", True), ("Çağla Işık", True), ("Clucher", False), ("E. B. Film", False), ("One Two Three Four Five", False),
    ("van der a b c d e", False), ("Ali & Veli", False), ("Ali Veli 3", False), ("Warner Bros Pictures", False), ("Lst Asst Director", False), ("Ali Direktoru", False), ("Ali Desigmer", False), ("Gelmistir Bir Ali", False), ("", False), ("  ", False),
])
def test_valid_person(spark, name, ok):
    assert one(spark, credits.valid_person(F.lit(name))) is ok
