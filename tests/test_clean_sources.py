"""Cleaning functions and file readers on small fixtures."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.functions import clean as C
from chronopanel.operators import quality as Q
from chronopanel.operators import windows as W
from chronopanel.sources import io as S


def values(spark, rows, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_ids(spark):
    assert values(spark, ["12", None, "123456789"], C.pad_id) == ["00000012", None, "12345678"]
    assert values(spark, ["none", "a", None], lambda c: C.has_id(c, "none")) == [False, True, None]


def test_flags(spark):
    assert values(spark, ["y", "N", None], C.flag_yes) == [True, False, None]
    assert values(spark, ["Yes", "yes", None], C.flag_yes_strict) == [True, False, False]


def test_dates(spark):
    assert values(spark, ["2020-12-31", "2020-12-31 10:00:00", "2020", "zz", "", None], C.safe_date) == [dt.date(2020, 12, 31)] * 2 + [None] * 4
    assert values(spark, ["31-DEC-2020", "31-Dec-2020", "zz", ""], lambda c: C.safe_date(c, "dd-MMM-yyyy")) == [dt.date(2020, 12, 31)] * 2 + [None] * 2
    assert values(spark, ["01/05/2020", "2020-01-05"], lambda c: C.safe_date(c, "MM/dd/yyyy")) == [dt.date(2020, 1, 5), None]


def test_explode_delimited(spark):
    df = spark.createDataFrame([(1, "a| b||A"), (2, None), (3, " ")], "id int, t string")
    assert sorted((r.id, r.token) for r in C.explode_delimited(df, "t").collect()) == [(1, "A"), (1, "A"), (1, "B")]


def test_era_and_status(spark):
    df = spark.createDataFrame([(dt.date(2017, 3, 13), "x"), (dt.date(2017, 3, 14), "y"), (None, None)], "d date, s string")
    assert C.era_filter(df, "d", "2017-03-14").count() == 2
    assert [r.is_x for r in C.status_flags(df, "s", {"is_x": "x"}).collect()] == [True, False, None]


def test_tagged_csv(spark, tmp_path):
    (tmp_path / "2019__a.csv").write_text('﻿Title row,,\nid,name,note\n1,"x, y",\n2,z,q\n', encoding="utf-8")
    (tmp_path / "2020__b.csv").write_text("Title\nid,name,note\n3,w,\n", encoding="utf-8")
    got = sorted((r.id, r.name, r.note, r.source_year_label, r.source_file) for r in S.read_tagged_csv(spark, f"{tmp_path}/*.csv", ["id", "name", "note"], "id").collect())
    assert got == [("1", "x, y", None, "2019", "2019__a.csv"), ("2", "z", "q", "2019", "2019__a.csv"), ("3", "w", None, "2020", "2020__b.csv")]


def test_headerless_extracts(spark, tmp_path):
    (tmp_path / "drug.txt").write_text('1,"",NA\n', encoding="utf-8")
    (tmp_path / "drug_ia.txt").write_text("2,b,c\n", encoding="utf-8")
    df = S.read_headerless_extracts(spark, str(tmp_path), "drug", ["id", "a", "b_f"], {"": "active", "_ia": "inactive", "_ap": "approved"})
    got = sorted((r.id, r.a, r.product_status_extract) for r in C.drop_by_suffix(df, "_f").collect())
    assert got == [("1", None, "active"), ("2", "b", "inactive")]
    assert S.read_headerless_extracts(spark, str(tmp_path), "none", ["id"], {"": "x"}).count() == 0


def test_latest_json(spark, tmp_path):
    rec = {"status": "Current", "openfda": {"route": ["ORAL", "IV"], "brand_name": []}}
    (tmp_path / "snap_2020.json").write_text(json.dumps({"results": []}))
    (tmp_path / "snap_2021.json").write_text(json.dumps({"results": [rec, {"status": "Old"}]}, indent=1))
    schema = T.StructType().add("status", "string").add("openfda", T.StructType().add("route", T.ArrayType(T.StringType())).add("brand_name", T.ArrayType(T.StringType())))
    df = S.read_latest_json(spark, f"{tmp_path}/snap_*.json", schema)
    got = [tuple(r) for r in S.flatten_records(df, ["status"], {"route": "openfda.route", "brand": "openfda.brand_name"}, {"routes": "openfda.route", "brands": "openfda.brand_name"}).collect()]
    assert got == [("Current", "ORAL", None, "ORAL|IV", None), ("Old", None, None, None, None)]


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), "x")], "a int, obs date, b string")
    S.write_table(df, f"{tmp_path}/t", ["obs"])
    S.write_table(df, f"{tmp_path}/t", ["obs"])
    assert S.read_panel(spark, f"{tmp_path}/t", ["a", "obs"]).collect() == df.select("a", "obs").collect()
    S.write_metrics(df, f"{tmp_path}/m")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/m").count() == 1


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "k int, s string")
    assert Q.check_unique(df, "k").collect()[0].n == 2
    assert {r["check"]: r.n_failed for r in Q.check_not_null(df, ["k", "s"]).collect()} == {"not_null(k)": 1, "not_null(s)": 1}
    assert Q.check_accepted_values(df, "s", ["a"]).collect()[0].s == "b"
    assert Q.check_range(df, "k", 2, 3).count() == 2
    assert Q.check_relationship(df, "k", df.where("k is null"), "k").count() == 2
    assert not Q.check_equal_rowcount(df, df.limit(1)).first()["equal"]


def test_preference_nulls_last(spark):
    df = spark.createDataFrame([("e", None, 1), ("e", "Y", 2), ("e", "X", 3), ("f", None, 4)], "e string, s string, code int")
    assert sorted((r.e, r.code) for r in W.prefer(df, ["e"], "s", ["X", "Y"], ["code"]).collect()) == [("e", 3), ("f", 4)]
