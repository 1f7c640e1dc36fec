"""Registered queries against their SQL on the smallest tables, in one session."""

import datetime as dt
import math

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PANEL = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)[:10]
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple"):
        return v
    return round(float(v), 6)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", PANEL)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 65


@pytest.mark.parametrize("name", ["e01_e02_logistic", "e03_boosted"])
def test_models_give_probabilities(spark, name):
    scores = [r.score for r in entry.queries()[name](spark, DATA).select("score").collect()]
    assert scores and 0 <= min(scores) <= max(scores) <= 1


def test_tables_by_schema(spark):
    from chronopanel.plans import audit

    spark.range(3).createOrReplaceTempView("some_view")
    assert any(r.n_tables >= 1 for r in audit.tables_by_schema(spark).collect())
