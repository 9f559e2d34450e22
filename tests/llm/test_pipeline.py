import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"stage{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == names
            assert 0 < out.count() <= n
            n, docs = out.count(), out
    assert out.select("doc_id").distinct().count() == n
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_near_dedup_takes_five_words_at_80(spark):
    block, scattered = ([f"{x}{k}" for k in range(n)] for x, n in (("a", 200), ("b", 400)))
    t = [(1, block), (2, block[:90] + [f"x{k}" for k in range(16)] + block[106:])]  # 0.81 by five words, 0.83 by three
    t += [(3, scattered), (4, [f"y{k}" if k % 40 == 20 else w for k, w in enumerate(scattered)])]  # 0.78 by five, 0.86 by three
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in t], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()) == [1, 3, 4]


WIDE = "doc_id long, text string, lang string, source string, n_chars long, id long, c long, h1 long, row string, spans string"


def wide(rows):
    return [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, "r", "s") for i, t, s in rows]


def through(spark, d, sf_dir):
    """What each stage makes of d, by name."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        d = corpus_pipeline.materialise(stage(spark, d, sf_dir), "through")
        out[name] = d
    return out


def test_repeated_rows_and_ids(spark, sf_dir, monkeypatch):
    """One of the rows that repeat one another stays, whole, whatever their ids are."""
    good = " ".join(f"word{k} stands" for k in range(60))
    other = " ".join(f"thing{k} moves" for k in range(60))
    third = " ".join(f"place{k} waits" for k in range(60))
    rows = [(5, good, "a"), (5, good, "a"), (None, other, "b"), (None, other, "b"), (None, other, None), (7, third, "c"), (7, good + " more", "c"), (8, None, "c"), (9, "", "d"), (9, "", "d"), (None, None, None)]
    monkeypatch.setattr(corpus_pipeline.fm, "THRESHOLD", 0.0)
    monkeypatch.setattr(corpus_pipeline.fm.keep, "__defaults__", (0.0,))
    d = spark.createDataFrame(wide(rows), WIDE)
    out = through(spark, d, sf_dir)
    for name in ("quality classifier", "quality rules", "MinHash near-dedup", "suffix-array dedup"):
        assert out[name].schema.names == d.schema.names
    assert out["quality classifier"].count() == len(rows)
    assert out["quality rules"].count() == 7
    assert sorted(((r.doc_id, r.text) for r in out["MinHash near-dedup"].collect()), key=repr) == sorted([(5, good), (None, other), (7, third)], key=repr)
    assert sorted(((r.doc_id, r.text) for r in out["suffix-array dedup"].collect()), key=repr) == sorted([(5, good), (None, other), (7, third)], key=repr)
    assert out["best-fit packing"].count() == 3


ODD = "doc_id long, text string, lang string, source string, n_chars long, `_gone_id` long, `_again_id` string, `a.b` long, `c``d` int, m map<string,int>, l array<struct<x:int>>"


def test_columns_of_any_name_and_type_and_nulls_that_change_places(spark, sf_dir, monkeypatch):
    """Rows that differ only in where a null stands are rows of their own; of those with one text one stays, a row without text isn't lost."""
    good = " ".join(f"word{k} stands" for k in range(60))
    other = " ".join(f"thing{k} moves" for k in range(60))
    more = (1, "x", 2, 3, {"k": 1}, [(1,)])
    rows = [(5, good, None, "x", 9, *more), (5, None, good, "x", 9, *more), (3, good, "en", "x", 9, *more)]
    rows += [(6, other, None, "x", None, *more), (6, other, "x", None, None, *more), (6, other, "x", None, None, *more), (6, other, "x", None, 4, *((None,) * 6))]
    monkeypatch.setattr(corpus_pipeline.fm, "THRESHOLD", 0.0)
    monkeypatch.setattr(corpus_pipeline.fm.keep, "__defaults__", (0.0,))
    d = spark.createDataFrame(rows, ODD)
    kept = corpus_pipeline.near_dedup(spark, d, sf_dir)
    assert kept.schema.names == d.schema.names
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, None), (3, good), (6, other)], key=repr)
    out = through(spark, d, sf_dir)
    for name in list(out)[:4]:
        assert out[name].schema.names == d.schema.names
    got = out["suffix-array dedup"]
    assert sorted((r.doc_id, r.text, r["_gone_id"], r["a.b"], r["c`d"], r.m, r.l[0].x) for r in got.where("doc_id = 3").collect()) == [(3, good, 1, 2, 3, {"k": 1}, 1)]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, good), (6, other)]
    assert out["best-fit packing"].count() == 2


def test_empty_table(spark, sf_dir):
    out = through(spark, spark.createDataFrame([], WIDE), sf_dir)
    assert all(d.count() == 0 for d in out.values())


def test_all_rows_go(spark, sf_dir):
    out = through(spark, spark.createDataFrame(wide([(1, None, None), (None, "", "x"), (2, " \n", "x")]), WIDE), sf_dir)
    assert out["quality rules"].count() == out["best-fit packing"].count() == 0


def test_run_drops_its_tables(spark, sf_dir):
    from cairnflow.llm.common import _MADE

    before = len(_MADE)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(_MADE) - before == len(corpus_pipeline.STAGES)


def test_run_keeps_its_results_at_any_address(spark, sf_dir, monkeypatch, tmp_path):
    """The shared folder may be named by a path, or a file: address of one slash; a stage may leave nothing."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("rules", corpus_pipeline.rules), ("nothing", lambda s, d, _: corpus_pipeline.materialise(d, "part").limit(0)), ("again", lambda s, d, _: d)])
    for k, scheme in enumerate(("", "file:", "file://")):
        folder = tmp_path / str(k)
        monkeypatch.setattr("cairnflow.llm.common.shared_dir", lambda s, at=f"{scheme}{folder}": at)
        assert corpus_pipeline.run(spark, sf_dir).count() == 0
        assert sorted(p.name.rpartition("-")[0] for p in folder.iterdir()) == ["again", "nothing", "rules"]
