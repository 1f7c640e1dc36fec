"""Edge dates of the event-history operators, by hand and against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import history as H
from chronopanel.operators import joins as J

LO, HI = "2020-01-01", "2021-12-01"
D = dt.date
EVENTS = "event_id int, entity string, owner string, grp string, start date, end date, duration int"


def frames(spark, events, entities=None):
    entities = entities or [("A", 1, "o", "g", D(2019, 1, 1), "MARKETED", None)]
    e = spark.createDataFrame(entities, "entity string, code int, owner string, grp string, first_date date, status string, status_date date")
    rows = [(i, ent, "o", "g", s, t, (t - s).days if t and t >= s else None) for i, ent, s, t in events]
    return H.entity_month_spine(e, LO, HI), spark.createDataFrame(rows, EVENTS), e


def at(df, obs, **where):
    return next(r.asDict() for r in df.collect() if r["obs"] == obs and all(r[k] == v for k, v in where.items()))


def test_event_on_the_observation_date(spark):
    spine, events, _ = frames(spark, [(1, "A", D(2020, 3, 1), D(2020, 3, 20))])
    label = H.forward_label(spine, events, LO, HI)
    assert at(label, D(2020, 3, 1))["in_event"] == 1 and at(label, D(2020, 3, 1))["label"] == 0
    assert at(label, D(2020, 2, 1))["label"] == 1
    assert at(H.own_history(spine, events, LO, HI), D(2020, 3, 1))["events_all"] == 0


def test_event_that_ends_on_the_observation_date(spark):
    spine, events, _ = frames(spark, [(1, "A", D(2020, 2, 10), D(2020, 3, 1))])
    assert at(H.forward_label(spine, events, LO, HI), D(2020, 3, 1))["in_event"] == 0
    own = H.own_history(spine, events, LO, HI)
    assert at(own, D(2020, 3, 1))["longest_days"] is None
    assert at(own, D(2020, 4, 1))["longest_days"] == 20


def test_window_edges(spark):
    spine, events, _ = frames(spark, [(1, "A", D(2020, 3, 1), None), (2, "A", D(2020, 2, 29), None)])
    own = H.own_history(spine, events, LO, HI)
    assert at(own, D(2021, 3, 1))["events_12m"] == 1
    assert at(own, D(2021, 2, 1))["events_12m"] == 2


def test_horizon_edges(spark):
    obs = D(2020, 5, 1)
    spine, events, _ = frames(spark, [(1, "A", obs + dt.timedelta(90), None)])
    assert at(H.forward_label(spine, events, LO, HI), obs)["label"] == 1
    spine, events, _ = frames(spark, [(1, "A", obs + dt.timedelta(91), None)])
    assert at(H.forward_label(spine, events, LO, HI), obs)["label"] == 0


def test_open_and_inverted_events(spark):
    spine, events, _ = frames(spark, [(1, "A", D(2020, 2, 10), None), (2, "A", D(2020, 6, 10), D(2020, 6, 1))])
    own = at(H.own_history(spine, events, LO, HI), D(2021, 12, 1))
    assert own["longest_days"] is None and own["events_all"] == 2
    assert at(H.forward_label(spine, events, LO, HI), D(2021, 12, 1))["in_event"] == 1


def test_repeated_id_counts_once_in_each_window(spark):
    spine, events, _ = frames(spark, [(1, "A", D(2020, 2, 10), D(2020, 2, 11)), (1, "A", D(2021, 5, 10), D(2021, 5, 11))])
    own = H.own_history(spine, events, LO, HI)
    assert at(own, D(2021, 6, 1))["events_all"] == 1 and at(own, D(2021, 6, 1))["events_12m"] == 1
    assert at(own, D(2020, 3, 1))["events_all"] == 1


def test_same_day_gap_is_zero(spark):
    spine, events, _ = frames(spark, [(1, "A", D(2020, 2, 10), None), (2, "A", D(2020, 2, 10), None), (3, "A", D(2020, 2, 20), None)])
    own = H.own_history(spine, events, LO, HI)
    assert at(own, D(2020, 3, 1))["mean_gap_days"] == 5.0
    spine, events, _ = frames(spark, [(1, "A", D(2020, 2, 10), None)])
    assert at(H.own_history(spine, events, LO, HI), D(2020, 3, 1))["mean_gap_days"] is None


def test_spine_limits(spark):
    entities = [
        ("A", 1, "o", "g", D(2021, 11, 2), "MARKETED", None), ("B", 2, "o", "g", None, "MARKETED", None), ("C", 3, "o", "g", D(2019, 1, 1), "CANCELLED X", None),
        ("E", 4, "o", "g", D(2019, 1, 1), "CANCELLED X", D(2020, 2, 1)), (None, 5, "o", "g", D(2019, 1, 1), "MARKETED", None),
    ]
    spine = H.entity_month_spine(spark.createDataFrame(entities, "entity string, code int, owner string, grp string, first_date date, status string, status_date date"), LO, HI)
    got = sorted((r.entity, r.obs) for r in spine.collect())
    assert got == [("A", D(2021, 12, 1)), ("E", D(2020, 1, 1)), ("E", D(2020, 2, 1))]


def test_no_future_record_changes_a_feature(spark):
    obs = D(2021, 1, 1)
    rows = [(i, "A", D(2019, 6, 1) + dt.timedelta(37 * i), D(2019, 6, 1) + dt.timedelta(37 * i + i % 40)) for i in range(25)]
    spine, events, _ = frames(spark, rows)
    past = events.where(F.col("start") < F.lit(obs)).withColumn("end", F.when(F.col("end") < F.lit(obs), F.col("end"))).withColumn("duration", F.when(F.col("end").isNotNull(), F.col("duration")))
    assert at(H.own_history(spine, events, LO, HI), obs) == at(H.own_history(spine, past, LO, HI), obs)


def test_null_owner_and_group(spark):
    entities = [("A", 1, None, None, D(2019, 1, 1), "MARKETED", None)]
    e = spark.createDataFrame(entities, "entity string, code int, owner string, grp string, first_date date, status string, status_date date")
    spine = H.entity_month_spine(e, LO, HI)
    events = spark.createDataFrame([(1, "A", None, None, D(2020, 2, 10), None, None)], EVENTS)
    assert H.owner_portfolio(e, LO, HI).count() == 0
    row = at(H.peer_events(spine, events, LO, HI), D(2020, 3, 1))
    assert row["peer_events_12m"] == 0 and row["peer_in_event_now"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_expansion_equals_range_join(spark, seed):
    rows = [(i, "AB"[(i * seed) % 2], D(2019, 11, 1) + dt.timedelta(i * 17 * seed % 700), D(2019, 11, 1) + dt.timedelta(i * 17 * seed % 700 + i * 7 % 60)) for i in range(40)]
    entities = [(x, 1, "o", "g", D(2019, 1, 1), "MARKETED", None) for x in "AB"]
    spine, events, _ = frames(spark, rows, entities)
    small = events.select("entity", "event_id", "start", "end")
    active = J.expand_active(small, LO, HI).select("entity", "obs", "event_id")
    assert sorted(active.collect()) == sorted(J.stab_join(spine.select("entity", "obs"), small).select("entity", "obs", "event_id").collect())
    ahead = J.expand_forward(small, LO, HI, 90).select("entity", "obs", "event_id")
    assert sorted(ahead.collect()) == sorted(J.forward_join(spine.select("entity", "obs"), small, 90).select("entity", "obs", "event_id").collect())


def test_event_measures(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 5), D(2020, 2, 1), D(2020, 1, 3)), (None, D(2020, 1, 5), None, D(2020, 1, 8))], "a date, s date, e date, t date")
    got = [tuple(r) for r in H.event_measures(df, "a", "s", "e", "t").select("duration_days", "lead_days", "estimate_error_days", "suspect_dates").collect()]
    assert got == [(None, 4, -29, True), (3, None, None, False)]


def test_spans_give_what_a_spine_gives(spark):
    rows = [(i, "AB"[i % 2], D(2019, 6, 1) + dt.timedelta(37 * i % 800), D(2019, 6, 1) + dt.timedelta(37 * i % 800 + i % 90)) for i in range(60)]
    entities = [("A", 1, "o", "g", D(2018, 1, 1), "MARKETED", None), ("A", 2, "p", "g", D(2020, 5, 5), "CANCELLED X", D(2020, 9, 9)), ("B", 3, "o", "h", D(2019, 1, 1), "MARKETED", None), ("C", 4, "o", "h", D(2020, 1, 1), "MARKETED", None)]
    spine, events, e = frames(spark, rows, entities)
    spans, keep = H.entity_spans(e, LO, HI), ("code", "owner")
    families = (*H.FAMILIES, "label")
    every = lambda s: sorted(map(str, H.own_history(s, events, LO, HI, families=families, keep=keep).select("entity", "obs", "code", "owner", *sorted(["events_all", "events_12m", "longest_days", "overdue_days", "days_since_first", "label", "in_event"])).collect()))
    assert every(spans) == every(spine) and len(every(spans)) == spine.count()
    # a row for each month is made after the last shuffle and sort, not before
    plan = H.longest_prior(spans, events, LO, HI)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Window") and "explode(sequence" not in plan[plan.index("Window"):]


def test_latest_family(spark):
    spine, events, e = frames(spark, [(1, "A", D(2020, 2, 1), None), (3, "A", D(2020, 2, 20), None), (2, "A", D(2020, 2, 20), None)])
    got = {r.obs: r.last for r in H.run_families(H.entity_spans(e, LO, HI), ["entity"], [H.latest_family(events, {"last": "event_id"}, ["event_id"])]).collect()}
    assert got[D(2020, 2, 1)] is None and got[D(2020, 3, 1)] == 3


def test_changes_outside_the_calendar_are_one_month_or_none(spark):
    spine, events, e = frames(spark, [(i, "A", D(2000, 1, 1) + dt.timedelta(50 * i), D(2000, 1, 1) + dt.timedelta(50 * i + 9)) for i in range(200)])
    changes = H.own_family(events, families=(*H.FAMILIES, "label"), reach=("2020-06-01", "2020-08-01")).changes
    assert {r.obs for r in changes.collect()} <= {D(2020, 6, 1), D(2020, 7, 1), D(2020, 8, 1)}
    short = {r.obs: r for r in H.own_history(H.entity_spans(e, "2020-06-01", "2020-08-01"), events, "2020-06-01", "2020-08-01").collect()}
    whole = {r.obs: r for r in H.own_history(spine, events, LO, HI).collect()}
    assert len(short) == 3 and all(whole[obs] == r for obs, r in short.items())
