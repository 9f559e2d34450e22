"""Periodic runs, near vectors and the filter audit against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest

from cairnflow.llm import filteraudit, nndescent, queries, runs

WORD = r"[^\x20\x09-\x0D]+"


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql(name, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{v}'")
    got = con.execute(queries.ORACLE_SQL[name])
    return [c[0] for c in got.description], got.fetchall()


def same(df, want):
    names, rows = want
    assert sorted(names) == sorted(df.columns)
    assert by_row(df.select(*names)) == sorted(rows, key=repr)


# -- periodic runs ----------------------------------------------------------


def plain_runs(w, least=12):
    """All stretches of every period, the smallest period of a place first."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            a = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > a and i - a + p >= max(least, 2 * p):
                out.setdefault((a, i - a + p), p)
            i = max(i, a + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def plain_digest(doc_id, text):
    w = re.findall(WORD, text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    long = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *long, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("block", [5, 64, runs.BLOCK])
def test_runs_equal_plain(monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    monkeypatch.setattr(runs, "CHUNK", 3)
    rng = random.Random(block)
    for _ in range(600):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 9])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 4 else 0):
            a, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(a, min(n, a + rng.randint(2, 40))):
                w[i] = w[a + (i - a) % p]
        for least in (12, 3):
            assert runs.runs(np.array(w, dtype=np.int32), least) == plain_runs(w, least)


def test_a_long_text_of_one_word_is_one_run():
    assert runs.runs(np.zeros(300_000, dtype=np.int32)) == [(0, 300_000, 1)]


def test_periodic_runs_query(spark, docs, texts, empty, sf_dir):
    tens = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    rng = random.Random(4)
    more = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80)))) for i in tens]
    d = docs.select("doc_id", "text", "spans", "length").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert by_row(runs.digest(runs.detect(d, edit=True))) == sorted((plain_digest(i, t) for i, t in [*texts, *more]), key=repr)
    assert runs.digest(runs.detect(empty, edit=True)).count() == 0
    want = sorted(plain_digest(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 8000)
    assert [r for r in by_row(queries.op11_periodic_runs(spark, sf_dir)) if r[0] in {x[0] for x in want}] == sorted(want, key=repr)


# -- near vectors -----------------------------------------------------------


def plain_links(rows, threshold=0.93):
    """n_links and component_id of each row (vec_id, embedding, label), vec_ids being distinct."""
    ok = [k for k, (i, v, label) in enumerate(rows) if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = rows[a][1], rows[b][1]
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y):
                x, y = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))  # or squares overflow
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a].append(b)
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        c = min((rows[m][0] for m in seen), default=None) if r[0] is not None else None
        out.append((r[0], len(near[k]), c, r[0] == c))
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, n long, node string, rep int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)


def turned(rng, u, cosine):
    v = rng.standard_normal(len(u))
    v -= v @ u * u / (u @ u)
    return (cosine * u / np.linalg.norm(u) + math.sqrt(1 - cosine**2) * v / np.linalg.norm(v)).tolist()


def test_near_vectors_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = [rng.standard_normal(8) for _ in range(30)]
    rows = [(100 + k, b.tolist(), k % 2) for k, b in enumerate(base)]
    rows += [(k, turned(rng, base[k], c), k % 2) for k, c in ((0, 0.96), (1, 0.931), (2, 0.929), (3, 0.5))]
    rows += [(10, base[4].tolist(), 0), (11, base[4].tolist(), 0), (12, base[4].tolist(), 1), (13, (3 * base[4]).tolist(), 0), (14, (-base[4]).tolist(), 0)]
    rows += [(20, None, 0), (21, [], 0), (22, [0.0] * 8, 0), (23, [None, 1.0], 0), (24, [float("nan"), 1.0], 0), (25, [float("inf"), 1.0], 0), (26, base[4].tolist(), None), (27, [1.0, 0.0], 0), (28, [1.0, -0.0], 0)]
    rows += [(29, [1e300, 0.0], 0), (30, [1e-300, 0.0], 0)]
    assert by_row(nndescent.near_vectors(vectors(spark, rows))) == plain_links(rows)
    odd = [(None, base[0].tolist(), 0), (None, base[0].tolist(), 0), (5, base[0].tolist(), 0), (5, base[0].tolist(), 0), (6, base[1].tolist(), 0)]
    assert by_row(nndescent.near_vectors(vectors(spark, odd))) == sorted([(None, 0, None, True)] * 2 + [(5, 1, 5, True)] * 2 + [(6, 0, 6, True)], key=repr)
    assert nndescent.near_vectors(vectors(spark, odd).limit(0)).count() == 0
    assert nndescent.near_vectors(vectors(spark, rows[:1])).first()["kept"]


def test_groups_larger_than_any_list(spark, monkeypatch):
    """Lists grow and end; components are counted whole, in blocks whose pairs all link, or none, or some."""
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    monkeypatch.setattr(nndescent.link_counts, "__defaults__", (16,))
    rng = np.random.default_rng(2)
    tight, wide, third = (rng.standard_normal(16) for _ in range(3))
    rows = [(k, turned(rng, tight, 0.995), 1) for k in range(150)] + [(200 + k, turned(rng, wide, rng.uniform(0.93, 1)), 1) for k in range(150)]
    rows += [(400 + k, third.tolist(), 2) for k in range(60)] + [(500 + k, turned(rng, third, 0.95), 2) for k in range(20)] + [(600 + k, rng.standard_normal(16).tolist(), 1) for k in range(300)]
    got, want = by_row(nndescent.near_vectors(vectors(spark, rows), k=4, most=8)), plain_links(rows)
    assert got == want


def test_recall_of_lone_pairs_in_a_narrow_cone(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 32)) + 0.5
    rows = [(k, b.tolist(), 0) for k, b in enumerate(base)] + [(2000 + k, turned(rng, base[k], rng.uniform(0.92, 0.97)), 0) for k in range(200)]
    got, want = {r[0]: r for r in by_row(nndescent.near_vectors(vectors(spark, rows)))}, {r[0]: r for r in plain_links(rows)}
    links = sum(r[1] for r in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)
    assert links > 100 and sum(r[1] for r in got.values()) >= 0.95 * links


def test_near_vectors_query(spark, sf_dir):
    same(queries.op12_near_vectors(spark, sf_dir), sql("op12_near_vectors", embeddings=f"{sf_dir}/embeddings.parquet"))


def test_near_vectors_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 6))
    rows = [(k, b.tolist(), k % 2) for k, b in enumerate(base)] + [(50 + k, turned(rng, base[k], 0.97), k % 2) for k in range(9)] + [(70, None, 1), (71, [0.0] * 6, 0), (72, [float("nan")] * 6, 0), (73, base[0].tolist(), None)]
    path = str(tmp_path / "embeddings.parquet")
    vectors(spark, rows).write.parquet(path)
    same(nndescent.near_vectors(spark.read.parquet(path)), sql("op12_near_vectors", embeddings=f"{path}/*.parquet"))


# -- filter audit -----------------------------------------------------------


def plain_audit(rows, labels):
    """Of rows (doc_id, text, source) and labels (doc_id, quality, toxic), by walking each order."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged = {}
    for i, t, part in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels) if i is not None else False for k in (1, 2))
        judged.setdefault(part or "", []).append((fails, good, toxic))
    out = []
    for part, docs in judged.items():
        shapley, mine = dict.fromkeys("ABCDE", 0), []
        for o in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(o, 1):
                gone = [d for d in left if d[0][f]]
                shapley[f] += len(gone)
                before = len(docs) - len(left)
                assert before == sum(any(d[0][x] for x in o[: step - 1]) for d in docs)
                redundant = sum(d[0][f] and any(d[0][x] for x in o[: step - 1]) for d in docs)
                left = [d for d in left if not d[0][f]]
                mine.append(("".join(o), step, f, len(left), len(gone), redundant, sum(sum(d[0].values()) == 1 and d[0][f] for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(part, o, step, *rest, shapley[f]) for o, step, f, *rest in mine]
    return sorted(out, key=repr)


@pytest.mark.parametrize("held", [3, filteraudit.HELD])
def test_filter_audit_of_odd_rows(spark, docs, texts, empty, held, monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["stone", "River", "a", "of", "the", "maple", "$5", "B"]) + str(rng.randint(0, 60))
    hot = " ".join(word() for _ in range(80))
    rows = [(k, hot, "s1" if k % 3 else None) for k in range(900, 1200)] + [(k, " ".join(word() for _ in range(rng.randint(40, 60))), "s2") for k in range(60)] + [(k, t, "") for k, t in texts]
    rows += [(None, hot, "s1"), (7, hot, "s1"), (7, hot, "s1"), (3, None, "s2"), (2, "", "s2")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 1200, 2)] + [(900, 1, 0), (900, 0, 1), (None, 1, 1), (7, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    monkeypatch.setattr(filteraudit, "HELD", held)
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert by_row(filteraudit.audit(filteraudit.counters(filteraudit.failures(d), said))) == plain_audit(rows, labels)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert filteraudit.audit(filteraudit.counters(filteraudit.failures(empty), said)).count() == 0
    assert filteraudit.audit(filteraudit.counters(filteraudit.failures(d), said.limit(0))).count() == 600 * 3


def test_filter_audit_query(spark, sf_dir):
    same(queries.op13_filter_audit(spark, sf_dir), sql("op13_filter_audit", documents=f"{sf_dir}/documents.parquet", labels=f"{sf_dir}/labels.parquet"))
