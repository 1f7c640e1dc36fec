"""Ranks, curves, quantiles and joins of time: against plain Python, and without a task that holds a whole key."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest

from chronopanel.operators import joins as J
from chronopanel.operators import prefix as X
from chronopanel.operators import quantiles as Q
from chronopanel.operators import ranking as R
from chronopanel.operators import windows as W


@pytest.fixture
def ranges(spark, monkeypatch):
    """16 shuffle partitions; gives the tables that were dealt into ranges."""
    seen, plain, was = [], X.in_ranges, spark.conf.get("spark.sql.shuffle.partitions")
    for module in (X, J):
        monkeypatch.setattr(module, "in_ranges", lambda df, keys, *a: seen.append((plain(df, keys, *a), keys)) or seen[-1][0])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield seen
    spark.conf.set("spark.sql.shuffle.partitions", was)


def largest_share(ranges, rows):
    """Of all rows, the largest part that one key has in one range."""
    return max(r["count"] for df, keys in ranges for r in df.groupBy(*keys, "_part").count().collect()) / rows


def test_a_hot_key_is_ranked_in_ranges(spark, ranges):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 400}", rng.random()) for i in range(12_000)] + [("hot", None), ("hot", 0.5), ("hot", 0.5), ("hot", math.nan), (None, 1.0)]
    got = W.average_rank(spark.createDataFrame(rows, "k string, s double"), ["k"], "s").collect()
    assert largest_share(ranges, len(rows)) < 0.15
    key = lambda s: (-1, 0) if s is None else (1, 0) if math.isnan(s) else (0, s)
    want = Counter()
    for k in {k for k, _ in rows}:
        own = sorted(key(s) for q, s in rows if q == k)
        first = {s: i for i, s in reversed(list(enumerate(own)))}
        n = Counter(own)
        want.update((k, s, first[s] + (n[s] + 1) / 2) for s in own)
    assert Counter((r.k, key(r.s), r["rank"]) for r in got) == want


def test_curves_of_unlike_scores_run_in_ranges(spark, ranges):
    rng = random.Random(2)
    rows = [("all", i, int(rng.random() < 0.2), round(rng.random(), rng.choice([1, 9]))) for i in range(3000)] + [("one", 1, 1, 0.3), ("flat", 1, 0, 0.5), ("flat", 2, 1, 0.5)]
    got = {r.k: r for r in R.compute_metrics(spark.createDataFrame(rows, "k string, entity int, label int, score double"), ["k"], [1]).collect()}
    assert largest_share(ranges, len(rows)) < 0.3
    y, s = (np.array([r[i] for r in rows if r[0] == "all"]) for i in (2, 3))
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
    area = np.mean([(pos >= x).sum() / (s >= x).sum() for x in pos])
    assert abs(got["all"].roc_auc - auc) < 1e-12 and abs(got["all"].pr_auc - area) < 1e-12
    assert got["one"].roc_auc is None and got["one"].pr_auc is None and (got["flat"].roc_auc, got["flat"].pr_auc) == (0.5, 0.5)
    df = spark.createDataFrame(rows, "k string, entity int, label int, score double")
    assert {r.k: r.roc_auc for r in R.roc_auc(df, ["k"]).collect()} == {k: r.roc_auc for k, r in got.items()}
    assert {r.k: r.pr_auc for r in R.pr_auc(df, ["k"]).collect()} == {k: r.pr_auc for k, r in got.items()}


def test_running_sums_without_keys(spark):
    got = X.running_sums(spark.range(100).withColumnRenamed("id", "x"), [], ["x"], {"s": R.F.col("x")}, totals=True, ranges=7).collect()
    assert {r.x: (r.s, r.s_total) for r in got} == {i: (i * (i + 1) // 2, 4950) for i in range(100)}
    assert X.running_sums(spark.range(0), [], ["id"], {"s": R.F.col("id")}).count() == 0


def test_codes_keep_the_order(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 2.0**-1022, 2.0**1023]
    values += [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-1074, 1023) for _ in range(3000)] + [s * 2.0**e for e in range(-1074, 1024) for s in (1, -1)]
    got = {r.v if r.v else 0.0: r.c for r in Q.with_code(spark.createDataFrame([(v,) for v in values], "v double"), "v", "c").collect()}
    for v, c in got.items():
        bits = int(np.float64(abs(v)).view(np.int64))
        assert c == (bits if v >= 0 else -bits), v
    nan, none = Q.with_code(spark.createDataFrame([(math.nan,), (None,)], "v double").coalesce(1), "v", "c").collect()
    assert nan.c > max(got.values()) and none.c is None


def test_quantiles_of_times_and_extremes(spark):
    rng = random.Random(4)
    times = rng.sample(range(1_700_000_000_000_000, 1_700_000_000_000_000 + 2 * 86_400_000_000), 20_000)
    points = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    for kind, values in (("long", times), ("double", [float(t) for t in times]), ("int", [t % 1000 - 500 for t in times]), ("double", [1 + t % 977 * 2.0**-52 for t in times])):
        got = Q.quantiles(spark.createDataFrame([(v,) for v in values], f"v {kind}"), [], "v", points).first()
        assert [got[n] for n in points] == pytest.approx([float(np.quantile(np.array(values, float), p)) for p in points.values()], rel=1e-15, abs=1e-9)
    rows = [("inf", v) for v in (-math.inf, -math.inf, 1.0, math.inf, math.inf)] + [("nan", v) for v in (1.0, 2.0, math.nan)] + [("far", -1.7e308), ("far", 1.7e308), ("zero", -0.0), ("zero", 0.0)]
    got = {r.k: list(map(str, r[1:])) for r in Q.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.0, "b": 0.5, "c": 1.0}).collect()}
    assert got == {"inf": ["-inf", "1.0", "inf"], "nan": ["1.0", "2.0", "nan"], "far": ["-1.7e+308", "0.0", "1.7e+308"], "zero": ["0.0", "0.0", "0.0"]}
    ends = [(-(1 << 63),), ((1 << 63) - 1,), (0,)]
    assert list(Q.quantiles(spark.createDataFrame(ends, "v long"), [], "v", {"a": 0.0, "b": 0.5, "c": 1.0}).first()) == [float(-(1 << 63)), 0.0, float(1 << 63)]


@pytest.mark.parametrize(("least", "most"), [(0, 0), (0, 40), (-5, 1 << 40), (-(1 << 63), (1 << 63) - 1), (1_700_000_000_000_000, 1_700_172_800_000_000)])
def test_a_round_counts_boundedly_and_the_last_one_single_values(least, most):
    rounds = Q._rounds(least, most)
    assert (most >> rounds[0]) - (least >> rounds[0]) <= 1 << Q.DIGIT and rounds[-1] == 0 and len(rounds) <= 5
    assert all(0 < a - b <= Q.DIGIT for a, b in zip(rounds, rounds[1:], strict=False))


DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def history():
    """A grid and events, most of one entity, with open, inverted and null bounds and repeats."""
    rng = random.Random(5)
    day = lambda most: DAY + dt.timedelta(days=rng.randint(0, most))
    who = lambda: rng.choice(["hot", "hot", "a", "b", None])
    grid = [(who(), rng.choice([day(900), day(900), None]), i) for i in range(400)]
    events = [(who(), rng.choice([i, i, i // 3]), s := rng.choice([day(800), day(800), None, DAY]), rng.choice([None, s, day(1000), s and s + dt.timedelta(days=rng.randint(1, 300))])) for i in range(300)]
    return grid, events


def frames(spark, history):
    return spark.createDataFrame(history[0], "entity string, obs date, n int"), spark.createDataFrame(history[1], "entity string, event_id int, start date, end date")


def pairs(history, holds):
    return Counter((g[2], e[1], e[2]) for g in history[0] for e in history[1] if g[0] is not None and g[0] == e[0] and g[1] and e[2] and holds(g[1], e[2], e[3]))


def test_joins_of_time_equal_all_comparisons(spark, history):
    grid, events = frames(spark, history)
    found = lambda df: Counter((r.n, r.event_id, r.start) for r in df.collect() if r.event_id is not None)
    assert found(J.stab_join(grid, events)) == pairs(history, lambda obs, s, t: s <= obs and (t is None or obs < t))
    assert found(J.forward_join(grid, events, 90)) == pairs(history, lambda obs, s, t: 0 < (s - obs).days <= 90)
    want = pairs(history, lambda obs, s, t: s < obs)
    assert found(J.asof_join(grid, events)) == want == found(J.asof_join(grid, events, "inner"))
    assert {r.n for r in J.asof_join(grid, events).collect()} == {g[2] for g in history[0]}
    assert J.asof_join(grid.limit(0), events).count() == 0 and J.asof_join(grid, events.limit(0)).count() == len(history[0]) and J.stab_join(grid, events.limit(0)).count() == 0


def test_a_hot_entity_is_spread_over_buckets(spark):
    grid = spark.createDataFrame([("hot", DAY + dt.timedelta(days=i)) for i in range(3000)], "entity string, obs date")
    plan = J.stab_join(grid, grid.withColumnsRenamed({"obs": "start"}).withColumn("end", R.F.date_add("start", 20)))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in text and plan.count() == 20 * 3000 - 190
    assert grid.select(J._bucket(R.F.col("obs"))).distinct().count() >= 3000 // J.BUCKET_DAYS


def test_latest_before(spark, history, ranges):
    grid, events = frames(spark, history)
    got = {r.n: r["last"] and (r["last"].start, r["last"].event_id) for r in J.latest_before(grid, events, ["event_id"]).collect()}
    want = {g[2]: max(((e[2], e[1]) for e in history[1] if g[0] is not None and g[0] == e[0] and g[1] and e[2] and e[2] < g[1]), default=None) for g in history[0]}
    assert got == want
    assert {r.n for r in J.latest_before(grid, events, ["event_id"], "inner").collect()} == {n for n, x in want.items() if x}
    assert J.latest_before(grid.limit(0), events, []).count() == 0 and J.latest_before(grid, events.limit(0), ["event_id"]).where("last is null").count() == len(history[0])


def test_overlaps_are_counted_without_pairs(spark, history, ranges):
    _, events = frames(spark, history)
    plain = Counter(a[0] for a in history[1] for b in history[1] if a[0] is not None and a[0] == b[0] and a[1] < b[1] and a[2] and b[2] and a[3] and a[2] < b[2] < a[3])
    assert {r.entity: r.pairs for r in J.overlap_counts(events).collect()} == dict(plain)
    assert Counter(r.entity for r in J.overlap_pairs(events).collect()) == plain
    assert J.overlap_counts(events.limit(0)).count() == 0


def test_a_hot_entitys_overlaps(spark, ranges):
    rng = np.random.default_rng(6)
    n = 6000
    ids, start = rng.permutation(n), rng.integers(0, 5000, n)
    end = start + rng.integers(0, 900, n)
    rows = [("hot", int(i), DAY + dt.timedelta(days=int(s)), DAY + dt.timedelta(days=int(t))) for i, s, t in zip(ids, start, end, strict=True)]
    want = sum(int(((ids > i) & (start > s) & (start < t)).sum()) for i, s, t in zip(ids, start, end, strict=True))
    got = J.overlap_counts(spark.createDataFrame(rows, "entity string, event_id int, start date, end date"))
    assert got.collect() == [("hot", want)]
    assert largest_share(ranges[-1:], ranges[-1][0].count()) < 0.15


def test_overlaps_of_short_histories_are_not_ranked(spark, ranges):
    rng = random.Random(7)
    sizes = {f"e{i}": rng.randint(1, 12) for i in range(60)} | {"few": J.FEW, "more": J.FEW + 1}
    rows = [(k, rng.choice([i, i, i // 2]), s := DAY + dt.timedelta(days=rng.randint(0, 90)), rng.choice([None, s + dt.timedelta(days=rng.randint(-3, 60))])) for k, n in sizes.items() for i in range(n)]
    want = Counter(a[0] for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] and a[2] < b[2] < a[3])
    count = lambda rows: {r.entity: r.pairs for r in J.overlap_counts(spark.createDataFrame(rows, "entity string, event_id int, start date, end date")).collect()}
    assert count([r for r in rows if r[0] != "more"]) == {k: n for k, n in want.items() if k != "more"} and want["few"]
    assert not ranges
    assert count(rows) == dict(want)
    assert ranges and {r.entity for df, _ in ranges for r in df.select("entity").distinct().collect()} == {"more"}


def test_a_split_reads_its_own_months_alone(spark, tmp_path):
    from chronopanel.plans import panel as P
    from chronopanel.sources import io as S

    rows = [(DAY.replace(month=m), i, 0, i % 2) for m in range(1, 13) for i in range(5)]
    P.write_by_month(spark.createDataFrame(rows, "obs date, entity int, in_event int, label int"), str(tmp_path / "panel"))
    split = P.exclude_and_split(S.read_panel(spark, str(tmp_path / "panel"), ["obs", "entity", "in_event", "label"]), {"test": ("2000-11-01", "2000-12-01")})
    assert split.count() == 10
    scan = next(x for x in split._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "obs" in filters and "in_event" in scan.split("PushedFilters")[1]


def test_a_dimension_of_any_side_tables(spark):
    from chronopanel.plans import dimension as D

    base = spark.createDataFrame([(1, "e"), (2, "e"), (3, None), (None, "f")], "code int, entity string")
    text = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, ""), (None, "x"), (9, "y")], "code int, value string")
    dated = spark.createDataFrame([(1, "old", dt.date(2000, 1, 1)), (1, "new", dt.date(2001, 1, 1)), (1, "new2", dt.date(2001, 1, 1)), (2, "only", None), (3, None, dt.date(1999, 1, 1))], "code int, value string, at date")
    sides = {"words": D.Side(text, "list"), "first": D.Side(text, "first"), "most": D.Side(text, "last"), "status": D.Side(dated, "latest", at="at"), "since": D.Side(dated, "earliest", at="at")}
    got = {r.code: r.asDict() for r in D.build_dimension(base, sides).collect()}
    assert got[1] == {"code": 1, "entity": "e", "words": "a + b", "words_count": 2, "first": "a", "first_count": 2, "most": "b", "status": "new2", "status_since": dt.date(2001, 1, 1), "since": dt.date(2000, 1, 1)}
    assert got[2]["status"] == "only" and got[2]["status_since"] is None and got[3]["words_count"] == 0 and got[3]["words"] is None and got[3]["since"] == dt.date(1999, 1, 1)
    assert got[None]["first_count"] == 0
    assert [r.code for r in D.canonical_by_entity(D.build_dimension(base, sides), "entity", "status", ["only", "new2"]).orderBy("code").collect()] == [None, 2]
    with pytest.raises(ValueError, match="how"):
        D.build_dimension(base, {"x": D.Side(text, "any")})


def test_side_tables_of_one_frame_are_one_pass(spark, tmp_path):
    import __spark_entry__ as entry
    from chronopanel.plans import dimension as D

    rng = random.Random(8)
    day = lambda: rng.choice([None, DAY + dt.timedelta(days=rng.randint(0, 40))])
    rows = [(rng.choice([0, 0, rng.randint(1, 300), None]), rng.choice([None, "", "a", "b", str(rng.randint(0, 99))]), day()) for _ in range(6000)]
    spark.createDataFrame(rows, "code int, v string, at date").repartition(7).write.parquet(str(tmp_path / "rows"))
    frame, base = spark.read.parquet(str(tmp_path / "rows")), spark.range(0, 400).selectExpr("int(id) as code")
    out = D.build_dimension(base, {h: D.Side(frame, h, value="v", at="at") for h in D.HOWS} | {"again": D.Side(frame, "first", value="at")})
    assert out.columns == ["code", "list", "list_count", "first", "first_count", "last", "latest", "latest_since", "earliest", "again", "again_count"]
    for r in out.collect():
        own = [x for x in rows if x[0] == r.code]
        values, dates = sorted({v for _, v, _ in own if v is not None}), sorted({str(d) for *_, d in own if d})
        late = max(((str(d or ""), v is not None, v or "") for _, v, d in own if v is not None or d), default=("", False, ""))
        assert r[1:6] == (" + ".join(values) or None, len(values), values[0] if values else None, len(values), values[-1] if values else None)
        assert (r.latest, str(r.latest_since or "")) == (late[2] if late[1] else None, late[0])
        assert (str(r.earliest or ""), r.again, r.again_count) == (dates[0] if dates else "", dates[0] if dates else None, len(dates))
    scans = lambda df, col: sum("Relation" in x and f"{col}#" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert scans(out, "v") == 1
    for name in ("o16_build_dimension", "o16_canonical_by_entity"):
        assert scans(entry.queries()[name](spark, "/root/testdata/sf0.001"), "l_partkey") == 1


def test_a_canonical_dimension_gathers_the_chosen_codes_alone(spark):
    import __spark_entry__ as entry
    from chronopanel.plans import dimension as D

    rng = random.Random(9)
    day = lambda: rng.choice([None, DAY + dt.timedelta(days=rng.randint(0, 9))])
    base = spark.createDataFrame([(None if i == 3 else i, rng.choice(["a", "b", "c", None]) if i > 3 else f"own {i}") for i in range(200)], "code int, entity string")
    rows = [(rng.choice([1, rng.randint(0, 220), None]), rng.choice([None, "", "x", "y", "z"]), day()) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "k int, v string, at date")
    kept = []

    def sides(keep):
        kept.append(keep(frame, "k"))
        return {h: D.Side(kept[-1], h, "k", "v", "at") for h in D.HOWS}

    for status, ranking in (("latest", ["y", "x"]), ("first", ["x"]), ("last", [])):
        want = D.canonical_by_entity(D.build_dimension(base, sides(lambda rows, column: rows)), "entity", status, ranking)
        got = D.canonical_dimension(base, sides, "entity", status, ranking)
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        chosen = {r.code for r in got.collect() if r.code is not None}
        assert got.count() == 7 and Counter(kept[-1].collect()) == Counter(r for r in rows if r[0] in chosen)
    plan = entry.queries()["o16_canonical_by_entity"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {kind: max(x.index("Join ") for x in plan if f"Join {kind}" in x) for kind in ("LeftSemi, (entity", "LeftOuter, (l_orderkey")}
    assert depth["LeftSemi, (entity"] > depth["LeftOuter, (l_orderkey"], "items are reduced before they meet their orders"


def test_a_large_month_is_written_by_several_tasks(spark, tmp_path):
    from chronopanel.plans import panel as P

    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        P.write_by_month(spark.range(0, 200_000, 1, 4).selectExpr("date'2000-01-01' as obs", "xxhash64(id) as entity"), str(tmp_path / "panel"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    assert len(list((tmp_path / "panel" / "obs=2000-01-01").glob("*.parquet"))) > 1 and spark.read.parquet(str(tmp_path / "panel")).count() == 200_000


def test_several_statuses_move_no_row_twice(spark):
    from chronopanel.plans import audit as A

    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "a", "x"), (2, "a", "x"), (2, "b", "y"), (3, "a", "x"), (3, "a", "y"), (4, "b", None), (4, "a", None), (None, "a", "x"), (None, "b", "y")], "k int, s string, a string")
    out = A.several_statuses(df, "k", "s", "a")
    assert out.collect() == [("a + b", 4, 2)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_the_models_panel_makes_no_signals_that_no_model_reads(spark, monkeypatch):
    from chronopanel.plans import panel as P
    from chronopanel.plans.proxy import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    whole = P.exclude_and_split(P.build_panel(t, categories=True))
    monkeypatch.setattr(Tables, "foreign_events", lambda self: pytest.fail("outside signals are made"))
    got = P.modelled(t)
    want = P.settled(whole.select(got.columns))
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
