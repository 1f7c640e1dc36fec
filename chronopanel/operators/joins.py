"""Joins of an (entity, observation date) grid with dated events, and key checks.

Dates are cut into buckets: an event is copied to the buckets that it touches and
joined on entity and bucket, instead of comparing each grid row with its entity's
whole history. Where only the latest event or a count is wanted, no pair is made.
The expansions of events to month starts are for grids of months alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import in_ranges, running_sums
from .staging import settled

OPEN = "9999-12-31"


def first_month_from(col: Column) -> Column:
    """The earliest month start that isn't before the date."""
    month = F.trunc(col, "month")
    return F.when(month == col, month).otherwise(F.add_months(month, 1))


def next_month(col: Column) -> Column:
    """The earliest month start after the date."""
    return F.add_months(F.trunc(col, "month"), 1)


def _months(df: DataFrame, first: Column, last: Column, out: str = "obs") -> DataFrame:
    df = df.withColumns({"_lo": first, "_hi": last}).where("_lo <= _hi")
    return df.withColumn(out, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month")))).drop("_lo", "_hi")


def expand_active(events: DataFrame, lo: str, hi: str, start: str = "start", end: str = "end") -> DataFrame:
    """One row for each month start in [lo, hi] with start <= obs < end; an open end never comes."""
    stop = F.coalesce(F.date_sub(F.col(end), 1), F.lit(OPEN).cast("date"))
    return _months(events, F.greatest(first_month_from(F.col(start)), F.lit(lo).cast("date")), F.least(F.trunc(stop, "month"), F.lit(hi).cast("date")))


def expand_forward(events: DataFrame, lo: str, hi: str, days: int, start: str = "start") -> DataFrame:
    """One row for each month start in [lo, hi] with obs < start <= obs + days."""
    first = first_month_from(F.date_sub(F.col(start), days))
    return _months(events, F.greatest(first, F.lit(lo).cast("date")), F.least(F.trunc(F.date_sub(F.col(start), 1), "month"), F.lit(hi).cast("date")))


def expand_window(events: DataFrame, lo: str, hi: str, months: int, start: str = "start") -> DataFrame:
    """One row for each month start in [lo, hi] with obs - months <= start < obs."""
    month = next_month(F.col(start))
    last = F.when(F.trunc(F.col(start), "month") == F.col(start), F.add_months(F.col(start), months)).otherwise(F.add_months(month, months - 1))
    return _months(events, F.greatest(month, F.lit(lo).cast("date")), F.least(last, F.lit(hi).cast("date")))


#: Days of a bucket of the interval joins.
BUCKET_DAYS = 64


def _bucket(date: Column) -> Column:
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / F.lit(BUCKET_DAYS)).cast("int")


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, first: Column, last: Column, how: str = "inner") -> DataFrame:
    """Points with each span of their key that holds them: first <= at <= last. ``how`` is inner or left.

    A span is copied to the buckets of time that it touches, as far as there are
    points, and a point is in one bucket, so each pair is made once, by an equality
    on key and bucket; a key of many rows is spread over its buckets. Null and
    inverted bounds hold nothing, a null key or date meets nothing.
    """
    points = points.withColumn("_bucket", _bucket(F.col(at)))
    reach = points.agg(F.min("_bucket").alias("_lo_b"), F.max("_bucket").alias("_hi_b"))  # one row
    spans = spans.withColumnsRenamed({key: "_e"}).withColumns({"_first": first, "_last": last}).where("_first <= _last").crossJoin(F.broadcast(reach))
    spans = spans.withColumns({"_lo_b": F.greatest(_bucket(F.col("_first")), "_lo_b"), "_hi_b": F.least(_bucket(F.col("_last")), "_hi_b")}).where("_lo_b <= _hi_b")
    spans = spans.withColumn("_b", F.explode(F.sequence("_lo_b", "_hi_b"))).drop("_lo_b", "_hi_b")
    on = (points[key] == spans["_e"]) & (points["_bucket"] == spans["_b"]) & (spans["_first"] <= points[at]) & (points[at] <= spans["_last"])
    return points.join(spans, on, how).drop("_e", "_b", "_bucket", "_first", "_last")


def stab_join(spine: DataFrame, events: DataFrame, entity: str = "entity", obs: str = "obs", start: str = "start", end: str = "end") -> DataFrame:
    """Grid rows with each event of their entity that is on: start <= obs < end; an open end never comes."""
    last = F.coalesce(F.date_sub(F.col(end), 1), F.lit(OPEN).cast("date"))
    return interval_join(spine, events, entity, obs, F.col(start), last)


def forward_join(spine: DataFrame, events: DataFrame, days: int, entity: str = "entity", obs: str = "obs", start: str = "start") -> DataFrame:
    """Grid rows with each event of their entity that starts in (obs, obs + days]."""
    return interval_join(spine, events, entity, obs, F.date_sub(F.col(start), days), F.date_sub(F.col(start), 1))


def asof_join(spine: DataFrame, events: DataFrame, how: str = "left", entity: str = "entity", obs: str = "obs", start: str = "start") -> DataFrame:
    """Grid rows with each event of their entity that started before obs; with ``how`` left also rows without one."""
    return interval_join(spine, events, entity, obs, F.date_add(F.col(start), 1), F.lit(OPEN).cast("date"), how)


def latest_before(spine: DataFrame, events: DataFrame, ties: list[str], how: str = "left", entity: str = "entity", obs: str = "obs", start: str = "start") -> DataFrame:
    """Grid rows with the last event of their entity that started before obs, of equal starts the one with the greatest ties.

    No pair is made: grid and events become one list by date, in ranges of (entity, date),
    along which the last event seen is carried; a range begins with the last one of the
    ranges before it. The event's columns come as one struct, ``last``, null where there is none (no
    row with ``how`` inner). Null entities and dates meet nothing.
    """
    fields = [start, *ties, *[c for c in events.columns if c not in {entity, start, *ties}]]
    here = spine.select(F.col(entity).alias("_e"), F.col(obs).alias("_d"), F.lit(0).alias("_kind"), F.struct(*spine.columns).alias("_row"))
    then = events.where(F.col(entity).isNotNull() & F.col(start).isNotNull()).select(F.col(entity).alias("_e"), F.col(start).alias("_d"), F.lit(1).alias("_kind"), F.struct(*fields).alias("_event"))
    then = then.groupBy("_e", "_d", "_kind").agg(F.max("_event").alias("_event"))  # structs compare by start, then ties
    rows = in_ranges(here.unionByName(then, allowMissingColumns=True), ["_e"], ["_d", "_kind"], "_part")
    per = rows.where("_kind = 1").groupBy("_e", "_part").agg(F.max("_event").alias("_end"))
    parts = rows.select("_e", "_part").distinct().join(per, ["_e", "_part"], "left")
    earlier = Window.partitionBy("_e").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_e").alias("_k"), F.col("_part").alias("_of"), F.max("_end").over(earlier).alias("_before"))
    inside = Window.partitionBy("_e", "_part").orderBy("_d", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_seen", F.max("_event").over(inside)).where("_kind = 0")
    joined = rows.join(parts, F.col("_e").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_of")), "left")
    last = F.coalesce("_seen", "_before")
    out = joined.select("_row.*", F.when(F.col("_e").isNotNull() & F.col("_d").isNotNull(), last).alias("last"))
    return out.where("last is not null") if how == "inner" else out


def anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't null and isn't in the other table, whatever nulls that has."""
    return left.where(F.col(key).isNotNull()).join(right.select(key).distinct(), key, "left_anti")


def seen_flag(left: DataFrame, right: DataFrame, key: str, out: str = "seen") -> DataFrame:
    """All rows, flagged by whether the other table has their key."""
    keys = right.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    return left.join(keys, left[key] == keys["_k"], "left").withColumn(out, F.col("_k").isNotNull()).drop("_k")


def overlap_pairs(events: DataFrame, entity: str = "entity", event_id: str = "event_id", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs a, b of an entity's events with a.id < b.id whose second starts strictly inside the first, by buckets of the starts."""
    side = lambda p: events.select(F.col(entity).alias("entity"), *[F.col(c).alias(f"{p}_{n}") for c, n in ((event_id, "id"), (start, "start"), (end, "end"))])
    pairs = interval_join(side("b"), side("a"), "entity", "b_start", F.date_add("a_start", 1), F.date_sub("a_end", 1)).where("a_id < b_id")
    return pairs.select("entity", "a_id", "a_start", "a_end", "b_id", "b_start", "b_end")


#: Up to so many rows of an entity are compared with each other to count overlaps; the rows of larger ones are counted along a tree.
FEW = 64


def overlap_counts(events: DataFrame, entity: str = "entity", event_id: str = "event_id", start: str = "start", end: str = "end") -> DataFrame:
    """(entity, pairs): how many pairs ``overlap_pairs`` would give, without making one; entities without any are left out.

    An entity of at most ``FEW`` rows is one row of a short list, compared with itself
    there; only the others, found by a count first, go through the tree's ranks and ranges.
    """
    df = events.select(F.col(entity).alias("entity"), F.col(event_id).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_t")).where("entity is not null and _id is not null and _s is not null")
    large = settled(df.groupBy("entity").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select("entity"), "large")
    if large.isEmpty():
        return _few_overlaps(df)
    return _few_overlaps(df.join(large, "entity", "left_anti")).unionByName(_tree_overlaps(settled(df.join(large, "entity", "left_semi"), "events")))


def _few_overlaps(df: DataFrame) -> DataFrame:
    """``overlap_counts`` of entities with few rows."""
    lists = df.groupBy("entity").agg(F.collect_list(F.struct("_id", "_s", "_t")).alias("_all"))
    partners = lambda a: F.size(F.filter("_all", lambda b: (a["_s"] < b["_s"]) & (b["_s"] < a["_t"]) & (a["_id"] < b["_id"])))
    return lists.select("entity", F.aggregate("_all", F.lit(0).cast("bigint"), lambda n, a: n + partners(a)).alias("pairs")).where("pairs > 0")


def _tree_overlaps(df: DataFrame) -> DataFrame:
    """``overlap_counts`` of entities of any size.

    The partners of a are the events of greater id with a start inside a. Ids are
    ranked; the ranks above a's are a few whole blocks of a binary tree over them, one for each
    0 bit of the rank. In each block two running counts by date, at the end and at the start of a, differ
    by its partners there. So an event gives a few rows for each level of its entity's tree, and the
    counts run by ranges of (entity, block, date): a large entity is spread over many tasks.
    """
    ids = running_sums(df.select("entity", "_id").distinct(), ["entity"], ["_id"], {"_rank": F.lit(1)}, totals=True)
    ids = ids.select("entity", "_id", (F.col("_rank") - 1).alias("_rank"), F.ceil(F.log2(F.col("_rank_total"))).cast("int").alias("_levels"))
    df = df.join(ids, ["entity", "_id"]).where("_levels > 0")
    blocks = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_levels") - 1))).withColumn("_block", F.expr("shiftright(_rank, _level)"))
    tree = ["entity", "_level", "_block"]
    points = blocks.where("_block % 2 = 1").select(*tree, F.col("_s").alias("_d"), F.lit(1).alias("_kind"), F.lit(1).alias("_point"), F.lit(0).alias("_sign"))
    asked = blocks.where("_block % 2 = 0 and _t > _s").withColumn("_block", F.col("_block") + 1)
    until = asked.select(*tree, F.col("_t").alias("_d"), F.lit(0).alias("_kind"), F.lit(0).alias("_point"), F.lit(1).alias("_sign"))  # starts before the end
    since = asked.select(*tree, F.col("_s").alias("_d"), F.lit(2).alias("_kind"), F.lit(0).alias("_point"), F.lit(-1).alias("_sign"))  # less those up to the start
    steps = points.unionByName(until).unionByName(since).groupBy(*tree, "_d", "_kind").agg(F.sum("_point").alias("_point"), F.sum("_sign").alias("_sign"))
    steps = running_sums(steps, tree, ["_d", "_kind"], {"_starts": F.col("_point")})
    return steps.groupBy("entity").agg(F.sum(F.col("_sign") * F.col("_starts")).alias("pairs")).where("pairs > 0")
