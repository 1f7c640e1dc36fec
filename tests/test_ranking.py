"""Ranking metrics on literal inputs with known answers."""

import datetime as dt

from chronopanel.operators import ranking as R
from chronopanel.operators import windows as W


def scored(spark, y, s, key="k"):
    return spark.createDataFrame([(key, i, label, float(score)) for i, (label, score) in enumerate(zip(y, s, strict=True))], "k string, entity int, label int, score double")


def precision(spark, y, s, k):
    return R.precision_at_k(scored(spark, y, s), ["k"], [k]).first()[f"p_at_{k}"]


def test_precision(spark):
    labels, scores = [1, 0, 1, 1, 0, 0, 1], [0.35, 0.62, 0.91, 0.17, 0.88, 0.04, 0.73]  # by score: 1 0 1 0 1 1 0
    assert [precision(spark, labels, scores, k) for k in (1, 2, 3, 5)] == [1.0, 0.5, 2 / 3, 3 / 5]
    assert precision(spark, labels, scores, 8) is None
    assert precision(spark, [0, 1, 0], [0.4, 0.4, 0.4], 2) == 0.5  # ties go by entity: rows 0 and 1


def test_one_class_has_no_curves_and_no_precision(spark):
    for label in (0, 1):
        row = R.compute_metrics(scored(spark, [label] * 6, [i / 8 for i in range(6)]), ["k"], [3]).first()
        assert row.roc_auc is None and row.pr_auc is None and row.p_at_3 is None and row.n == 6
        assert abs(row.brier - sum((i / 8 - label) ** 2 for i in range(6)) / 6) < 1e-12
    assert precision(spark, [1, 1], [0.3, 0.2], 1) is None


def test_metrics_equal_plain_python(spark):
    import random

    rng = random.Random(2)
    labels, scores = [rng.randint(0, 1) for _ in range(60)], [rng.randint(0, 12) / 13 for _ in range(60)]
    row = R.compute_metrics(scored(spark, labels, scores), ["k"], [7]).first()
    pos, neg = [s for y, s in zip(labels, scores, strict=True) if y], [s for y, s in zip(labels, scores, strict=True) if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    area = sum(sum(p >= s for p in pos) / sum(x >= s for x in scores) for s in pos) / len(pos)
    top = sorted(range(60), key=lambda i: (-scores[i], i))[:7]
    assert abs(row.roc_auc - auc) < 1e-12 and abs(row.pr_auc - area) < 1e-12 and row.p_at_7 == sum(labels[i] for i in top) / 7


def test_perfect_and_tied(spark):
    row = R.compute_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), ["k"], [2]).first()
    assert row.roc_auc == 1.0 and row.pr_auc == 1.0
    row = R.compute_metrics(scored(spark, [0, 1, 0, 1], [0.5] * 4), ["k"], [2]).first()
    assert row.roc_auc == 0.5 and row.pr_auc == 0.5


def test_average_rank(spark):
    rows = [("p", 7.0), ("p", 3.0), ("p", 7.0), ("p", 7.0), ("p", None), ("q", -2.5), ("q", 0.0), (None, 4.0)]
    got = sorted(W.average_rank(spark.createDataFrame(rows, "m string, s double"), ["m"], "s").collect(), key=str)
    assert sorted((str(r.m), str(r.s), r["rank"]) for r in got) == [("None", "4.0", 1), ("p", "3.0", 2), *[("p", "7.0", 4)] * 3, ("p", "None", 1), ("q", "-2.5", 1), ("q", "0.0", 2)]


def test_blend(spark):
    df = spark.createDataFrame([("u", 4.0, 10.0), ("u", 9.0, 10.0), ("u", 1.0, 20.0), ("v", 0.5, 0.0)], "m string, a double, b double")
    got = {(r.m, r.a): r.blend for r in R.blend_scores(df, ["m"], "a", "b").collect()}
    assert got == {("u", 4.0): 2 * 2 + 1.5, ("u", 9.0): 2 * 3 + 1.5, ("u", 1.0): 2 * 1 + 3, ("v", 0.5): 3.0}


def test_score_bins_close_right_and_merge(spark):
    df = scored(spark, [0, 1] * 5, [1, 1, 1, 1, 2, 3, 4, 5, 6, 7])
    got = [r["bin"] for r in R.score_bins(df, 5).orderBy("score").collect()]
    assert got[0] == 0 and max(got) <= 4 and got == sorted(got)


def test_fixed_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (9.0,), (None,)], "x double")
    got = [r.b for r in df.select(R.fixed_buckets(F.col("x"), [0, 1, 3], ["low", "high"]).alias("b")).collect()]
    assert got == [None, "low", "high", None, None]


def test_jitter_is_small_and_stable(spark):


    df = spark.createDataFrame([(i, dt.date(2020, 1, 1)) for i in range(50)], "entity int, obs date")
    a = df.select(R.jitter("entity", "obs").alias("j")).collect()
    b = df.repartition(5).orderBy("entity").select(R.jitter("entity", "obs").alias("j")).collect()
    assert a == b and all(0 <= r.j < 1e-9 for r in a) and len({r.j for r in a}) > 40


def test_quantiles_equal_the_interpolated_ones(spark):
    import random

    import numpy as np

    from chronopanel.operators.quantiles import quantiles

    rng = random.Random(4)
    values = {"a": [rng.choice([0.0, -1.5, 2.25, 3e9, -4e-9, rng.gauss(0, 3)]) for _ in range(301)], None: [rng.randint(-3, 3) / 2 for _ in range(40)], "one": [7.5], "none": []}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None), ("a", None)]
    df, points = spark.createDataFrame(rows, "k string, v double"), {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in quantiles(df, ["k"], "v", points).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, p in points.items():
            assert got[k][name] is None if not vs else abs(got[k][name] - np.quantile(vs, p)) <= 1e-9 * max(1, abs(got[k][name]))
    assert quantiles(df.where("v is null"), [], "v", points).collect() == [(None,) * 5]
    assert abs(quantiles(df, [], "v", points).first().p50 - np.median([v for vs in values.values() for v in vs])) < 1e-12
