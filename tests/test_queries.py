"""Every query that has SQL gives the same rows as DuckDB does."""

import decimal
import math

import duckdb
import pytest

from cairnflow import catalogue, plans  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "None" if math.isnan(v) else f"{v + 0.0:.7g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, sf_dir, name):
    """The queries without SQL are in test_plain."""
    got = catalogue.queries()[name](spark, sf_dir)
    data = [tuple(r) for r in got.collect()]
    want = db.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, data) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs_twice_alike(spark, sf_dir, name):
    """Without SQL: rows that don't depend on how the table lies in its partitions."""
    got = catalogue.queries()[name](spark, sf_dir)
    one = rows(got.columns, [tuple(r) for r in got.collect()])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(got.columns, [tuple(r) for r in catalogue.queries()[name](spark, sf_dir).collect()]) == one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_flagship(spark, sf_dir):
    assert catalogue.flagship(spark, sf_dir).columns == ["grp", "shared"]
