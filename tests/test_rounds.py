"""Operators that work in rounds over tables, against loops over one key's rows at a time."""

import difflib
import random

import loops
import pytest
from pyspark.sql import functions as F

from cairnflow import catalogue, plans  # noqa: F401
from cairnflow.functions import names as N
from cairnflow.functions import similarity
from cairnflow.functions import text as T
from cairnflow.operators import graphs, nearness, pieces, quantiles, rounds, spellings, tracks
from cairnflow.plans.ordered import named


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- graphs -------------------------------------------------------------------


def smallest(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


def test_components_of_paths_stars_and_blobs(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(150)] + [(500, 600 + k) for k in range(60)] + [(rng.randint(1000, 1060), rng.randint(1000, 1060)) for _ in range(40)] + [(9, 9), (2, 1)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == smallest(edges)
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert rows_of(graphs.components(names)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert graphs.components(names.limit(0)).count() == 0


def test_roots_of_long_paths(spark):
    got = graphs.roots(spark.createDataFrame([(k, k - 1) for k in range(1, 70)] + [(101, 100)], "node long, parent long"))
    assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(1, 70)} | {(101, 100)}


# -- tracks ---------------------------------------------------------------------

BOXES = "key string, row long, t long, x double, y double, w double, h double, text string, confidence double"


def scene(rng, key, n):
    """Texts that drift, appear and vanish, some misread, and a grid of equal texts whose scores tie."""
    out, shown = [], []
    for t in range(n):
        if rng.random() < 0.05:
            shown.append([rng.uniform(0, 600), rng.uniform(0, 300), rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice(["ALPHA BETA", "GAMMA", "DELTA FOO", "ALPHA BETO"]), rng.randint(5, 150)])
        for s in shown:
            s[0], s[1], s[5] = s[0] + s[2], s[1] + s[3], s[5] - 1
            if rng.random() < 0.8:
                out.append((t, s[0], s[1], 60.0, 18.0, s[4] if rng.random() < 0.9 else s[4][:-1], rng.choice([None, 0.3, 0.7, 0.9])))
        shown = [s for s in shown if s[5] > 0]
        if n // 4 < t < n // 2:
            out += [(t, 10.0 + 40 * k, 5.0, 30.0, 18.0, "SAME", 0.9) for k in range(3)]
        if t % 31 == 0:
            out.append((t, 1.0, 1.0, 0.0, 9.0, "FLAT", 0.9))
    return [(key, k, *r) for k, r in enumerate(out)]


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(7)
    rows = scene(rng, "hot", 260) + scene(rng, "b", 40) + scene(rng, None, 60) + [("gap", 0, 3, 1.0, 1.0, 9.0, 9.0, "ONE", 0.9), ("gap", 1, 900, 1.0, 1.0, 9.0, 9.0, "ONE", 0.9), ("none", 0, 3, 1.0, 1.0, 9.0, 9.0, None, 0.9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("frames", "warm"), [(512, 64), (37, 20), (11, 3)])
def test_tracks_are_the_same_at_any_cut(spark, boxes, frames, warm):
    names = BOXES.replace(",", "").split()[::2]
    want = []
    for key in ("hot", "b", None, "gap", "none"):
        want += [(key, r["row"], r["track"], r["vx"], r["vy"]) for r in tracks.track_boxes()([dict(zip(names, b)) for b in boxes if b[0] == key])]
    d = spark.createDataFrame(boxes, BOXES).withColumn("extra", F.lit(1)).repartition(3)
    assert rows_of(tracks.track_segments(d, "key", frames=frames, warm=warm)) == sorted(want, key=repr)
    assert tracks.track_segments(d.limit(0), "key").count() == 0


def test_a_recording_is_many_groups(spark, boxes):
    """No group holds more of a recording than a segment and the frames before it."""
    spread = []

    def watch(rules):
        run = tracked(rules)

        def seen(pdf):
            out = run(pdf)
            return out.assign(births=out["births"] * 0 + (pdf["t"].max() - pdf["t"].min()))

        return seen

    tracked, tracks._tracked = tracks._tracked, watch
    written, tracks.written = tracks.written, lambda d, what: spread.append(d) or written(d, what) if what == "tracked" else written(d, what)
    try:
        tracks.track_segments(spark.createDataFrame([b for b in boxes if b[0] == "hot"], BOXES), "key", frames=20, warm=10).count()
    finally:
        tracks._tracked, tracks.written = tracked, written
    spans = [r.births for r in spread[0].where("births is not null").collect()]
    assert len(spans) >= 12 and max(spans) < 30


def test_box_tracks_of_the_whole_table(spark, sf_dir):
    """The query's rows are those of one fold over each user's boxes."""
    got = rows_of(catalogue.queries()["box_tracks"](spark, sf_dir))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value", "event_type", T.screen_text("event_type").alias("text")).toPandas()
    want = []
    for user, rows in e.groupby("user_id"):
        rows = rows.sort_values(["ts", "event_id"]).to_dict("records")
        given = [{"row": r["event_id"], "t": k // 3, "x": r["event_id"] % 7 * 40.0, "y": r["value"] * 2, "w": len(r["event_type"]) * 9.0, "h": 18.0, "text": r["text"], "confidence": r["event_id"] % 5 / 4.0} for k, r in enumerate(rows, 1)]
        want += [(user, r["row"], r["track"], r["vx"], r["vy"]) for r in tracks.track_boxes()(given)]
    assert got == sorted(want, key=repr)


# -- indexes of near texts --------------------------------------------------------


def table(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_within_edits_is_all_pairs(spark, edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    a, b = [word() for _ in range(120)] + [None, "é1"], [word() for _ in range(120)] + [None, "e1"]
    got = {tuple(r) for r in nearness.within_edits(table(spark, a, "l"), table(spark, b, "r"), "l", "r", edits).collect()}
    assert got == {(x, y, N.edits(x, y, 20)) for x in a for y in b if None not in (x, y) and N.edits(x, y, 20) <= edits}
    assert nearness.within_edits(table(spark, a, "l").limit(0), table(spark, b, "r"), "l", "r").count() == 0


@pytest.mark.parametrize("least", [0.4, 0.55, 0.7, 0.86, 0.94])
def test_similar_texts_is_all_pairs(spark, least):
    rng = random.Random(7)
    a, b = (["".join(rng.choice("ab cd") for _ in range(rng.randint(0, 16))) for _ in range(120)] + [None, "", "aaaaaaaa", "aaaa"] for _ in "ab")
    for t in ("haenatouv", "abcdefgh", "qrstuvwxyz"):  # gaps on either side in turn
        a, b = a + [t], b + [t[:3] + "r" + t[3:4] + t[5:], t[1:] + "x", t[:2] + "q" + t[2:], t[:4] + t[5:]]
    got = {tuple(r) for r in nearness.similar_texts(table(spark, a, "t"), table(spark, b, "t"), "t", least).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert got == {(x, y, ratio(x, y)) for x in a for y in b if x and y and ratio(x, y) >= least}
    keyed = table(spark, a, "t").withColumn("k", F.length("t") % 3)
    assert {(r.l, r.r) for r in nearness.similar_texts(keyed, keyed, "t", least, "k").collect()} == {(x, y) for x in a for y in a if x and y and len(x) % 3 == len(y) % 3 and ratio(x, y) >= least}
    with pytest.raises(ValueError):
        nearness.similar_texts(keyed, keyed, "t", 1.5)


def test_names_inside_lines_is_all_windows(spark):
    rng = random.Random(3)
    words = ["ali", "veli", "kaya", "mert", "demir", "ozturk", "x", "Kayaalp"]
    lines = [" ".join(rng.choice(words) + rng.choice(["", "", "s", "."]) for _ in range(rng.randint(0, 8))) for _ in range(150)] + [None, "", "alikay", "ALİ KAYA"]
    who = ["ali kaya", "mert demir", "veli ozturk", "kayas merts", "ali", "demirveli", "Özturk Ali", None, "aaaaa", "x kayaalp x", "Haen a to"]
    lines += ["donston haernto than", "haerntox", "qqq haento", "xhaenarto z"]
    for least in (0.8, 0.9):
        got = {(r.line, r.name) for r in nearness.names_inside(table(spark, lines, "line"), table(spark, who, "name"), "line", "name", least).collect()}
        assert got == {(x, y) for x in lines for y in who if x is not None and y is not None and N.embedded(x, y, least)}


def test_near_names_is_all_pairs(spark):
    rng = random.Random(4)
    parts = ["ali", "aly", "kaya", "kaye", "merte", "merta", "demir", "denir", "oz", "ozturk", "oztork", "murat", "murad"]
    who = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(150)}) + [None, "", "?"]
    got = {(r.a, r.b) for r in nearness.near_names(table(spark, who, "name"), "name").collect()}
    assert got == {(a, b) for a in who for b in who if a and b and a != b and (N.matches(a, b) or N.close(a, b))}


def test_person_gate(spark):
    people = spark.createDataFrame([(1, "Ali Kaya", ["cast"], "w"), (2, "Aly Kaya", ["director"], "v"), (3, "Ali Kayo", ["cast"], "v"), (4, "Bo Li", ["cast"], "v"), (5, "Ali Kaya", ["cast"], "v"), (6, None, ["cast"], "v")], "person_id long, person string, roles array<string>, source string")
    asked = spark.createDataFrame([("ALI KAYA", "cast"), ("Ali Kaya", "director"), ("Ali Kaya", "producer"), ("Bo Le", "cast"), ("Cli Kaya", "cast"), (None, "cast")], "name string, role string")
    got = {(r.name, r.role): (r.person_id, r.edits) for r in nearness.person_gate(asked, people, "role").collect()}
    assert got == {("ALI KAYA", "cast"): (5, 0), ("Ali Kaya", "director"): (2, 1), ("Bo Le", "cast"): (4, 1)}


def test_names_in_lines_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    names = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        n = " ".join(r.text.split()[:3])
        names[r.item_id] = n[:4] + "x" + n[5:] if r.item_id % 3 == 0 else n
    got = {tuple(r) for r in catalogue.queries()["names_in_lines"](spark, sf_dir).collect()}
    some = [d for d in docs if d.doc_id % 25 == 0 and len(d.text) < 3000] + [d for d in docs if d.doc_id in {g[1] for g in got} and len(d.text) < 2000][:5]
    want = {(i, d.doc_id, k) for d in some for k, line in enumerate(d.text.split("\n")) for i, n in names.items() if N.embedded(line, n)}
    assert want == {g for g in got if g[1] in {d.doc_id for d in some}} and want


# -- rounds ---------------------------------------------------------------------------

PAIRS = "by string, a long, b long"


@pytest.fixture(scope="module")
def links():
    rng = random.Random(3)
    return [("x", a, b) for a in range(50) for b in range(a + 1, 50) if rng.random() < 0.09] + [("y", 0, 1), ("y", 1, 2), ("y", 2, 3)]


NODES = [("x", k) for k in range(50)] + [("y", k) for k in range(5)]


def test_matching_is_greedy(spark):
    rng = random.Random(3)
    pairs = [(k, a, b, rng.randint(1, 5) / 5) for k in "xy" for a in range(20) for b in range(20) if rng.random() < 0.3]
    used, want = set(), []
    for q, b, k, a in sorted(((q, b, k, a) for k, a, b, q in pairs), key=lambda x: (x[0], x[3], x[2], x[1]), reverse=True):
        if not {("l", k, a), ("r", k, b)} & used:
            used |= {("l", k, a), ("r", k, b)}
            want.append((k, a, b, q))
    d = spark.createDataFrame(pairs, "by string, l long, r long, q double")
    assert rows_of(rounds.matched(d, ["by", "l"], ["by", "r"], ["q"])) == sorted(want, key=repr)
    assert rounds.matched(d.limit(0), ["by", "l"], ["by", "r"], ["q"]).count() == 0


def test_leaders_and_first_groups(spark, links):
    d, n = spark.createDataFrame(links, PAIRS), spark.createDataFrame(NODES, "by string, node long")
    leader, group = {}, {}
    for by, k in NODES:
        near = [a for y, a, b in links if y == by and b == k]
        leader[by, k] = next((a for a in near if leader[by, a] == a), k)
        group[by, k] = min((group[by, a] for a in near), default=k)
    assert {(r.by, r.node): r.leader for r in rounds.leaders(n, d).collect()} == leader
    assert {(r.by, r.node): r.group for r in rounds.first_groups(n, d).collect()} == group
    assert rows_of(rounds.leaders(n, d.limit(0))) == sorted(((b, k, k) for b, k in NODES), key=repr)
    assert rounds.leaders(n.limit(0), d.limit(0)).count() == rounds.first_groups(n.limit(0), d.limit(0)).count() == 0


def test_survivors(spark, links):
    rng = random.Random(5)
    lose = [(*p, rng.choice([p[1], p[2], None])) for p in links]
    gone = set()
    for by, a, b, k in sorted(lose, key=lambda p: p[:3]):
        if k is not None and not {(by, a), (by, b)} & gone:
            gone.add((by, k))
    got = rounds.survivors(spark.createDataFrame(NODES, "by string, node long"), spark.createDataFrame(lose, PAIRS + ", loser long"))
    assert rows_of(got) == sorted(set(NODES) - gone, key=repr)


@pytest.mark.parametrize("per_episode", [1, 3, 8])
def test_vetoed_clusters(spark, per_episode):
    rng = random.Random(per_episode)
    names = [f"n{k}" for k in range(25)]
    near = {(a, b) for a in names for b in names if a != b and rng.random() < 0.12}
    rows = [(k, rng.choice(names), pos // per_episode, pos) for k in "xy" for pos in range(60)]
    want = {}
    for k in "xy":
        mine = [r for r in rows if r[0] == k]
        first = {}
        for r in mine:
            first.setdefault(r[1], r[3])
        by_order = list(first.values())
        for r in loops.spelling_clusters(lambda a, b: (a, b) in near)([{"episode": r[2], "text": r[1]} for r in mine]):
            want[k, r["text"]] = by_order[r["cluster"]]
    d = spark.createDataFrame(rows, "by string, item string, mark long, pos long")
    pairs = spark.createDataFrame([(k, a, b) for k in "xy" for a, b in near], "by string, a string, b string")
    assert {(r.by, r.item): r.cluster for r in rounds.vetoed_clusters(d, pairs).collect()} == want


# -- the queries over whole tables ---------------------------------------------------


def by_item(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


@pytest.fixture(scope="module")
def people(spark, sf_dir):
    return [r.asDict() for r in named(spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def batches(spark, sf_dir):
    rows = sorted((r.asDict() for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()), key=lambda r: r["p_partkey"])
    return by_item([r | {"item": r["p_partkey"] // 40} for r in rows], "item")


def test_fuzzy_clusters_query(spark, sf_dir, batches):
    want = [(i, r["row"], r["text"]) for i, rows in batches.items() for r in loops.transitive_clusters(0.8)([{"row": r["p_partkey"], "text": r["p_name"], "confidence": r["p_retailprice"]} for r in rows])]
    assert rows_of(catalogue.queries()["fuzzy_clusters"](spark, sf_dir)) == sorted(want, key=repr)


def test_clone_collapse_query(spark, sf_dir, batches):
    want = [(i, r["row"], r["text"]) for i, rows in batches.items() for r in loops.clone_collapse(0.75)([{"row": r["p_partkey"], "text": r["p_name"], "evidence": r["p_size"] % 4, "known": r["p_size"] > 40} for r in rows])]
    assert rows_of(catalogue.queries()["clone_collapse"](spark, sf_dir)) == sorted(want, key=repr)


def counted(people):
    out = {}
    for r in people:
        k = r["source"], r["text"]
        out[k] = out.get(k, 0) + 1
    return by_item([{"source": s, "text": t, "n": n} for (s, t), n in sorted(out.items(), key=lambda x: (-x[1], x[0][1]))], "source")


def test_variant_merge_query(spark, sf_dir, people):
    want = [(s, r["text"], r["n"]) for s, rows in counted(people).items() for r in loops.variant_merge(0.7)(rows)]
    assert rows_of(catalogue.queries()["variant_merge"](spark, sf_dir)) == sorted(want, key=repr)


def test_spelling_groups_query(spark, sf_dir, people):
    want = [(s, r["text"], r["n"], r["members"]) for s, rows in counted(people).items() for r in loops.spelling_groups()(rows)]
    assert rows_of(catalogue.queries()["spelling_groups"](spark, sf_dir)) == sorted(want, key=repr)


def test_spelling_clusters_query(spark, sf_dir, people):
    """Spellings put together over all series, and by the operator on made rows with titles."""
    d = named(spark, sf_dir).select("source", (F.col("doc_id") % 97).alias("episode"), "text", ((F.col("doc_id") % 97) * (1 << 40) + F.col("doc_id")).alias("pos"))
    got = {}
    for r in spellings.clusters(d, "source", "episode", "text", "pos").collect():
        got.setdefault((r.source, r.cluster), set()).add((r.text, r.n))
    want = []
    for s, rows in by_item(people, "source").items():
        groups = {}
        for r in loops.spelling_clusters()([{"episode": x["doc_id"] % 97, "text": x["text"]} for x in sorted(rows, key=lambda x: (x["doc_id"] % 97, x["doc_id"]))]):
            groups.setdefault(r["cluster"], set()).add((r["text"], r["n"]))
        want += [(s, g) for g in groups.values()]
    assert sorted(((s, sorted(g)) for (s, _), g in got.items()), key=repr) == sorted(((s, sorted(g)) for s, g in want), key=repr)
    assert catalogue.queries()["spelling_clusters"](spark, sf_dir).count() == len(want)
    made = [(1, "Anna Karen"), (2, "Prof. Dr. Anna Karen"), (3, "Anna Karon"), (4, "Anna Karen"), (4, "Ana Karen"), (5, "Scott Paulin"), (6, "Pauline Chan"), (7, " "), (8, "Murat"), (9, "Murad"), (10, "Dr.Op. Scott Paulin"), (11, "Dr Dr"), (12, None)]
    rows = spark.createDataFrame([("s", e, t, k) for k, (e, t) in enumerate(made)], "s string, e long, t string, pos long")
    first = {}
    for k, (_, t) in enumerate(made):
        first.setdefault((t or "").strip(), k)
    first.pop("")
    order = list(first.values())
    want = {r["text"]: (order[r["cluster"]], r["n"]) for r in loops.spelling_clusters()([{"episode": e, "text": t} for e, t in made])}
    assert {r.t: (r.cluster, r.n) for r in spellings.clusters(rows, "s", "e", "t", "pos").collect()} == want


# -- folds in pieces -----------------------------------------------------------------

MARKS = "key string, pos long, s double, e double, type string, label string, metric double, confidence double, hash long"


@pytest.fixture(scope="module")
def marks():
    """Long keys, a null one, and stretches in which nothing but the parity of the beginning tells what is joined."""
    rng = random.Random(9)
    out = []
    for key, n in (("hot", 220), ("b", 40), (None, 30), ("one", 1), ("odd", 61)):
        t = 0.0
        for k in range(n):
            a = t + rng.choice([0.0, 0.2, 3.0, 9.0])
            t = a + rng.choice([0.5, 2.0, 7.0])
            kind = "AU"[k % 2] if key == "odd" or 100 < k < 180 else rng.choice("AABU")
            out.append((key, k, a, t if key != "odd" else a + 0.5, kind, rng.choice(["x", "x", "x", "y", "u", "u", "m"]), rng.random(), rng.random(), rng.choice([None, 0, 1, 2, 7, 255, -1])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("piece", [16, 1 << 14])
def test_folds_in_pieces_are_the_loops(spark, marks, piece):
    names = MARKS.replace(",", "").split()[::2]
    keys = by_item(sorted((dict(zip(names, m)) for m in marks), key=lambda r: r["pos"]), "key")
    d = spark.createDataFrame(marks, MARKS)
    cases = [
        (pieces.capped_merge(20.0, 1.0), loops.capped_merge(20.0, 1.0), "s double, e double, n int", ["s", "e", "n"]),
        (pieces.merge_windows(0.5), loops.merge_windows(0.5), "s double, e double, type string, metric double", ["s", "e", "type", "metric"]),
        (pieces.smooth_bridges("U", 1.0), loops.smooth_bridges("U", 1.0), "s double, e double, type string", ["s", "e", "type"]),
        (pieces.overlap_groups(0.2), loops.overlap_groups(0.2), "s double, e double, n int", ["s", "e", "n"]),
        (pieces.regimes("u", 1), loops.regimes("u", 1, 1), "label string, first long, last long, n long", ["label", "first", "last", "n"]),
    ]
    for machine, loop, schema, columns in cases:
        got = pieces.fold_in_pieces(d, "key", ["pos"], machine, schema, piece)
        assert rows_of(got) == sorted(((k, n, *(r[c] for c in columns)) for k, rows in keys.items() for n, r in enumerate(loop(rows))), key=repr)
    chunks = pieces.merged_chunks(d, "key", ["pos"], 800.0, 4.0, 20.0, 1.0, 0.25, piece)
    assert rows_of(chunks) == sorted(((k, r["chunk"], r["s"], r["e"], r["n"]) for k, rows in keys.items() for r in loops.merged_chunks(800.0, 4.0, 20.0, 1.0, 0.25)(rows)), key=repr)
    for threshold, keep in ((1, 2), (2, 1), (60, 3)):
        assert rows_of(pieces.thinned(d, "key", "pos", "hash", threshold, keep, piece)) == sorted(((k, r["pos"]) for k, rows in keys.items() for r in loops.anchor_dedup(threshold, keep)(rows)), key=repr)
    gaps = d.where("coalesce(key, '') <> 'b' OR pos <> 7").withColumn("label", F.when(F.col("key") == "odd", "m").otherwise(F.col("label")))
    want = []
    for k, rows in keys.items():
        rows = [r | {"label": "m" if k == "odd" else r["label"]} for r in rows if not (k == "b" and r["pos"] == 7)]
        want += [(k, r["decision"], r["onset"]) for r in loops.onset("y", 0.2, "u", "m", 2, 2)(rows)]
    assert rows_of(pieces.onsets(gaps, "key", "y", 0.2, "u", "m", 2, 2, piece)) == sorted(want, key=repr)
    assert pieces.thinned(d.limit(0), "key", "pos", "hash", 1, 2).count() == pieces.onsets(d.limit(0), "key", "y", 0.2, "u", "m", 2, 2).count() == 0


def test_guesses_spare_rounds(spark):
    """A machine that guesses all its states is folded once, however its state is carried on."""
    parity = pieces.Machine(lambda s, r: (1 - s, [{"odd": s}]), start=0, guesses=[1])
    folded = []
    real, pieces.written = pieces.written, lambda d, what: (folded.append(what), real(d, what))[1]
    try:
        d = spark.range(200).select(F.lit("k").alias("key"), F.col("id").alias("pos"))
        got = pieces.fold_in_pieces(d, "key", ["pos"], parity, "odd int", 8)
        assert rows_of(got) == sorted((("k", k, k % 2) for k in range(200)), key=repr)
    finally:
        pieces.written = real
    assert folded.count("folded") == 1
    with pytest.raises(ValueError):
        pieces.fold_in_pieces(d, "key", ["pos"], parity, "odd int", 12)


# -- quantiles -------------------------------------------------------------------------


@pytest.mark.parametrize("bins", [256, quantiles.BINS])
def test_exact_quantiles(spark, bins):
    rng = random.Random(2)
    rows = [("even", k / 7) for k in range(501)] + [("same", 4.0)] * 90 + [("two", v) for v in [1.0] * 500 + [2.0]] + [("wild", rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12)) for _ in range(200)]
    rows += [("near", 1.0), ("near", 1.0000000000000002), ("one", -3.5), ("none", None), ("nan", float("nan")), ("nan", 2.0), (None, 5.0), (None, 7.0), ("big", -1.7e308), ("big", 1.7e308), ("big", 1e307)]
    rng.shuffle(rows)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    want = {}
    for key, vs in by_item([{"k": k, "v": v} for k, v in rows if v is not None and v == v], "k").items():
        x = sorted(r["v"] for r in vs)
        want[key] = []
        for p in probs:
            at = p * (len(x) - 1)
            k = int(at)
            want[key].append(x[k] + (x[min(k + 1, len(x) - 1)] - x[k]) * (at - k) if at > k else x[k])
    got = {r.key: r.q for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", probs, bins).collect()}
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-12), key
    assert quantiles.exact_quantiles(spark.createDataFrame(rows, "key string, v double").limit(0), ["key"], "v", probs).count() == 0
    assert quantiles.exact_quantiles(spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "v double"), [], "v", [0.5]).first().q == [2.0]


# -- alignment ---------------------------------------------------------------------------


def test_alignment_by_waves_is_the_one_by_rows(monkeypatch):
    rng = random.Random(1)
    for _ in range(2000):
        k = rng.choice([1, 2, 3, 9])
        a = [str(rng.randrange(k)) for _ in range(rng.randint(0, 14))]
        b = [str(rng.randrange(k)) for _ in range(rng.randint(0, 14))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        want = similarity._by_rows(a, b)
        assert similarity.alignment(a, b) == want
        assert similarity.edit_distance(a, b) == sum(op != "M" for op, _, _ in want)
    a = [str(rng.randrange(500)) for _ in range(4000)]
    b = [x for x in a if rng.random() < 0.99]
    want = similarity._by_rows(a, b)
    assert similarity.alignment(a, b) == want and similarity.edit_distance(a, b) == len(a) - len(b)
    monkeypatch.setattr(similarity, "MOST_PLACES", 10)
    assert similarity.alignment(a[:300], b[:280]) == similarity._by_rows(a[:300], b[:280])


def test_holding_is_all_pairs(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None]
    needles = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 5))) for _ in range(60)] + [None, "zzz", "abcabcabcabcabc"]
    got = {tuple(r) for r in nearness.holding(table(spark, needles, "n"), table(spark, texts, "t"), "n", "t").collect()}
    assert got == {(n, t) for n in needles for t in texts if n and t and n in t}
