"""Event-history features at month starts, from records strictly before each of them.

A *spine* has one row for each (entity, obs), obs being a month start, or as *spans* one row for each
entity with its first and last month, which become months at the very end. Events have event_id, entity, owner, grp, start, end (null: open) and duration. Every
measure is a running window over monthly deltas: an event adds to the month in which it
begins to count and takes away in the month in which it ends to, so it is two rows
however long it counts, and a key has at most one row for each month before anything is
sorted. Events and history are never multiplied by the spine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import OPEN, first_month_from, next_month
from .staging import settled

AGE_DAYS = 365.25
#: A month before all others, for what holds at any time.
FIRST_MONTH = "0001-01-01"


def entity_spans(entities: DataFrame, lo: str, hi: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(entity, code, owner, grp, first_date, columns in ``also``, from_obs, to_obs): the months of ``entity_month_spine``, one row for all those of an entity's row."""
    until = F.when(F.col("status").startswith("CANCELLED"), F.col("status_date")).otherwise(F.lit(OPEN).cast("date"))
    first = F.trunc("first_date", "month")
    first = F.when(first == F.col("first_date"), first).otherwise(F.add_months(first, 1))
    df = entities.where("entity is not null and first_date is not null")
    df = df.withColumns({"from_obs": F.greatest(first, F.lit(lo).cast("date")), "to_obs": F.least(F.trunc(until, "month"), F.lit(hi).cast("date"))})
    df = df.where(until.isNotNull() & (F.col("from_obs") <= F.col("to_obs")))
    return df.select("entity", "code", "owner", "grp", "first_date", *also, "from_obs", "to_obs")


def _each_month(first: Column | str, last: Column | str) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("obs")


def entity_month_spine(entities: DataFrame, lo: str, hi: str) -> DataFrame:
    """(obs, entity, code, owner, grp, first_date): months from the first date until a cancelled entity's status date.

    Entities without id or first date give no rows, nor do cancelled ones without a status date.
    """
    return entity_spans(entities, lo, hi).select(_each_month("from_obs", "to_obs"), "entity", "code", "owner", "grp", "first_date")


def active_span(start: str = "start", end: str = "end") -> tuple[Column, Column]:
    """First and last month start with start <= obs < end; an open end never comes."""
    stop = F.coalesce(F.date_sub(F.col(end), 1), F.lit(OPEN).cast("date"))
    return first_month_from(F.col(start)), F.trunc(stop, "month")


def window_span(months: int, start: str = "start") -> tuple[Column, Column]:
    """First and last month start with obs - months <= start < obs."""
    month = next_month(F.col(start))
    last = F.when(F.trunc(start, "month") == F.col(start), F.add_months(F.col(start), months)).otherwise(F.add_months(month, months - 1))
    return month, last


def deltas(events: DataFrame, keys: list[str], spans: dict[str, tuple[Column, Column]], points: dict[str, tuple[Column, Column]] | None = None, reach: tuple[str, str] | None = None) -> DataFrame:
    """Events -> (keys, obs, names): +1 at a span's first month and -1 after its last, and the values of points in their months.

    Points that share a name's end in ``_max`` or ``_min`` are reduced so, all others are summed up. Months are null where there is none.
    For a spine inside ``reach`` what comes before it is one row of its first month, what comes after it none.
    """
    points = points or {}
    columns = {n: F.lit(1) for n in spans} | {n: v for n, (_, v) in points.items()}
    mark = lambda when, name, value: F.struct(when.alias("obs"), *[F.when(F.lit(n == name), value if n == name else c).alias(n) for n, c in columns.items()])
    marks = []
    for n, (first, last) in spans.items():
        marks += [mark(F.when(first <= last, first), n, F.lit(1)), mark(F.when(first <= last, F.add_months(last, 1)), n, F.lit(-1))]
    marks += [mark(month, n, value) for n, (month, value) in points.items()]
    rows = events.select(*keys, F.inline(F.array(*marks))).where("obs is not null")
    if reach:
        rows = rows.where(F.col("obs") <= F.lit(reach[1]).cast("date")).withColumn("obs", F.greatest("obs", F.lit(reach[0]).cast("date")))
    how = lambda n: F.max(n) if n.endswith("_max") else F.min(n) if n.endswith("_min") else F.sum(n)
    return rows.groupBy(*keys, "obs").agg(*[how(n).alias(n) for n in columns])


def running(spine: DataFrame, changes: DataFrame, keys: list[str], aggregates: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Spine rows (keys, obs and the columns to ``keep``) with running aggregates over deltas of their key with month <= obs.

    Deltas are summed up by month already, so a key has at most a row for each
    month. Without columns to keep, spine rows are reduced to distinct ones first. A spine of spans
    (from_obs and to_obs in place of obs, as ``entity_spans`` gives) is told by its columns.
    """
    if "obs" not in spine.columns:
        return along_spans(spine, changes, keys, aggregates, keep or [])
    values = [c for c in changes.columns if c not in (*keys, "obs")]
    own = [c for c in keep or [] if c not in (*keys, "obs")]
    empty = lambda df, names: {n: F.lit(None).cast(df.schema[n].dataType) for n in names}
    points = spine.select(*keys, "obs", *own) if keep else spine.select(*keys, "obs").distinct()
    both = points.withColumns(empty(changes, values) | {"_spine": F.lit(1)}).unionByName(changes.withColumns(empty(spine, own) | {"_spine": F.lit(0)}))
    w = Window.partitionBy(*keys).orderBy("obs", "_spine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select(*keys, "obs", *own, "_spine", *[a.over(w).alias(n) for n, a in aggregates.items()]).where("_spine = 1").drop("_spine")


def along_spans(spans: DataFrame, changes: DataFrame, keys: list[str], aggregates: dict[str, Column], keep: list[str]) -> DataFrame:
    """What ``running`` gives for the months from from_obs to to_obs of each span, without sorting or shuffling a row for each month.

    The window runs over the changes alone: what holds from one month of changes until the next
    is one row, which meets its key's spans; only then do both become months. Spans of null keys have none.
    """
    own = [c for c in keep if c not in (*keys, "obs")]
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    begin = spans.select(*keys, F.lit(FIRST_MONTH).cast("date").alias("obs"))  # so that a key's states cover all months
    order = Window.partitionBy(*keys).orderBy("obs")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.add_months(F.lead("obs").over(order), -1), F.lit(OPEN).cast("date"))
    states = changes.unionByName(begin, allowMissingColumns=True).select(*[F.col(k).alias(n) for k, n in names.items()], F.col("obs").alias("_from"), until.alias("_until"), *[a.over(upto).alias(n) for n, a in aggregates.items()])
    first, last = F.greatest("from_obs", "_from"), F.least("to_obs", "_until")
    on = first <= last  # of equal months the last one has it all, the others last no month
    for k, n in names.items():
        on &= F.col(k) == F.col(n)
    return spans.join(states, on).select(*keys, _each_month(first, last), *own, *aggregates)


def _label_spans(horizon: int) -> dict[str, tuple[Column, Column]]:
    return {"_on": active_span(), "_soon": (first_month_from(F.date_sub(F.col("start"), horizon)), F.trunc(F.date_sub(F.col("start"), 1), "month"))}


def _labels() -> dict[str, Column]:
    on = F.coalesce(F.col("_on"), F.lit(0)) > 0
    return {"in_event": on.cast("int"), "label": (~on & (F.coalesce(F.col("_soon"), F.lit(0)) > 0)).cast("int")}


def forward_label(spine: DataFrame, events: DataFrame, lo: str, hi: str, horizon: int = 90) -> DataFrame:
    """Adds in_event and label: an event starts in (obs, obs + horizon] and none is on at obs."""
    clean = events.where("entity is not null and start is not null")
    changes = deltas(clean, ["entity"], _label_spans(horizon), reach=(lo, hi))
    own = ["obs", *[c for c in spine.columns if c not in ("obs", "from_obs", "to_obs")]]
    out = running(spine, changes, ["entity"], {"_on": F.sum("_on"), "_soon": F.sum("_soon")}, own)
    return out.withColumns(_labels()).select(*own, "in_event", "label")


def id_deltas(events: DataFrame, keys: list[str], months: list[int], name: str, start: str = "start", distinct: str = "event_id", ever: str | None = None, reach: tuple[str, str] | None = None) -> DataFrame:
    """(keys, obs, {name}_{n}m ...): changes of the number of distinct ids that started in [obs - n months, obs), and ``ever`` those of all time.

    Starts of one id count up to the month in which its next start takes over, so that its spans are apart; a start that
    repeats counts for no month but in its last row.
    """
    w = Window.partitionBy(*keys, distinct).orderBy(start)
    rows = events.where(F.col(distinct).isNotNull()).select(*keys, distinct, start)
    rows = rows.withColumns({"_next": F.lead(start).over(w), "_nth": F.row_number().over(w)})
    until = F.add_months(next_month(F.col("_next")), -1)
    spans = {f"{name}_{n}m": (window_span(n, start)[0], F.least(window_span(n, start)[1], until)) for n in months}
    points = {ever: (F.when(F.col("_nth") == 1, next_month(F.col(start))), F.lit(1))} if ever else None
    return deltas(rows, keys, spans, points, reach)


def key_grid(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Each key that occurs with every month of the calendar."""
    return df.select(*keys).distinct().withColumn("obs", F.explode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.expr("interval 1 month"))))


FAMILIES = ("counts", "recency", "longest", "cycle")


@dataclass
class Family:
    """Measures of one key: changes by (key, obs), aggregates that run over them, and columns made of these."""

    changes: DataFrame
    sums: dict[str, Column]
    columns: dict[str, Column]


def run_families(spine: DataFrame, keys: list[str], families: list[Family], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, obs, columns to ``keep``, all families' columns): their changes are one list under one running window."""
    changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.changes for f in families])
    out = running(spine, changes, keys, {n: c for f in families for n, c in f.sums.items()}, ["obs", *keep])
    return out.select(*keys, "obs", *[c for c in keep if c not in (*keys, "obs")], *[c.alias(n) for f in families for n, c in f.columns.items()])


def some(col: str) -> Column:
    return F.coalesce(col, F.lit(0))


def own_family(events: DataFrame, months: tuple[int, ...] = (12, 36), families: tuple[str, ...] = FAMILIES, horizon: int = 90, reach: tuple[str, str] | None = None) -> Family:
    """Counts by window and of all time, recency, longest completed event, mean gap and overdue days, label (as ``forward_label``), as far as asked for.

    Ids are counted once in each window; gaps are between rows, so a repeated day is a gap of 0.
    """
    clean = events.where("entity is not null and start is not null")
    month, points, spans, sums = next_month(F.col("start")), {}, {}, {}
    if "recency" in families or "cycle" in families:
        points |= {"_last_max": (month, F.col("start")), "_first_min": (month, F.col("start"))}
        sums |= {"_last": F.max("_last_max"), "_first": F.min("_first_min")}
    if "cycle" in families:
        points["_n"] = (month, F.lit(1))
        sums["_n"] = F.sum("_n")
    if "longest" in families:
        done = F.col("end").isNotNull() & F.col("duration").isNotNull()
        points["_long_max"] = (F.when(done, next_month(F.greatest("end", "start"))), F.col("duration"))
        sums["_longest"] = F.max("_long_max")
    if "label" in families:
        spans |= _label_spans(horizon)
        sums |= {"_on": F.sum("_on"), "_soon": F.sum("_soon")}
    changes = deltas(clean, ["entity"], spans, points, reach) if points or spans else None
    if "counts" in families:
        ids = id_deltas(clean, ["entity"], list(months), "events", ever="_ids", reach=reach)
        sums |= {f"_events_{n}m": F.sum(f"events_{n}m") for n in months} | {"_events_all": F.sum("_ids")}
        changes = ids if changes is None else changes.unionByName(ids, allowMissingColumns=True)
    added: dict[str, Column] = {}
    if "label" in families:
        added |= _labels()
    if "counts" in families:
        added |= {f"events_{n}m": some(f"_events_{n}m") for n in months} | {"events_all": some("_events_all"), "was_ever": some("_events_all") > 0}
    since = F.datediff("obs", "_last")
    if "recency" in families:
        added |= {"days_since_last": since, "days_since_first": F.datediff("obs", "_first")}
    if "longest" in families:
        added["longest_days"] = F.col("_longest")
    if "cycle" in families:
        gap = F.when(F.col("_n") >= 2, F.datediff("_last", "_first") / (F.col("_n") - 1).cast("double"))
        added |= {"mean_gap_days": gap, "overdue_days": since - gap}
    return Family(changes, sums, added)


def own_history(spine: DataFrame, events: DataFrame, lo: str, hi: str, months: tuple[int, ...] = (12, 36), families: tuple[str, ...] = FAMILIES, keep: tuple[str, ...] = (), horizon: int = 90) -> DataFrame:
    """(entity, obs, columns to ``keep``) with the families asked for: counts, recency, longest, cycle, label."""
    return run_families(spine, ["entity"], [own_family(events, months, families, horizon, (lo, hi))], keep)


def prior_event_counts(spine: DataFrame, events: DataFrame, lo: str, hi: str, months: tuple[int, ...] = (12, 36)) -> DataFrame:
    return own_history(spine, events, lo, hi, months, ("counts",))


def event_recency(spine: DataFrame, events: DataFrame, lo: str, hi: str) -> DataFrame:
    return own_history(spine, events, lo, hi, families=("recency",))


def longest_prior(spine: DataFrame, events: DataFrame, lo: str, hi: str) -> DataFrame:
    return own_history(spine, events, lo, hi, families=("longest",))


def event_cycle(spine: DataFrame, events: DataFrame, lo: str, hi: str) -> DataFrame:
    return own_history(spine, events, lo, hi, families=("cycle",))


def _begun(entities: DataFrame, keys: list[str], lo: str, hi: str, out: str) -> DataFrame:
    """(keys, obs, out): entities of the key that begin to exist in each month, those from before in the first one."""
    known = entities.where("first_date is not null")
    month = F.trunc("first_date", "month")
    begins = F.greatest(F.when(month == F.col("first_date"), month).otherwise(F.add_months(month, 1)), F.lit(lo).cast("date"))
    return known.select(*keys, "entity", begins.alias("obs")).groupBy(*keys, "obs").agg(F.countDistinct("entity").alias(out)).where(F.col("obs") <= F.lit(hi).cast("date"))


def _standing(entities: DataFrame, keys: list[str], lo: str, hi: str, out: str) -> DataFrame:
    """(keys, obs, out): entities whose first date isn't after obs; months before the first entity are left out."""
    changes = _begun(entities, keys, lo, hi, out)
    return running(key_grid(changes, keys, lo, hi), changes, keys, {out: F.sum(out)}, ["obs"]).where(F.col(out).isNotNull())


def owner_portfolio(entities: DataFrame, lo: str, hi: str) -> DataFrame:
    """(owner, obs, portfolio): entities of the owner that exist by obs; those that left stay in."""
    return _standing(entities.where("owner is not null"), ["owner"], lo, hi, "portfolio")


def guarded(n: Column, d: Column) -> Column:
    """n / d as a double, 0 where d is 0 or absent."""
    return F.when(F.coalesce(d, F.lit(0)) > 0, F.coalesce(n, F.lit(0)).cast("double") / d).otherwise(F.lit(0.0))


def owner_family(entities: DataFrame, events: DataFrame, lo: str, hi: str) -> Family:
    """Of each owner: portfolio, events in 12 and 3 months, their rates and the difference of these; portfolio is null before its first entity."""
    begun = _begun(entities.where("owner is not null"), ["owner"], lo, hi, "portfolio")
    counts = id_deltas(events.where("owner is not null and start is not null"), ["owner"], [12, 3], "owner_events")
    sums = {"_portfolio": F.sum("portfolio"), "_owner_12m": F.sum("owner_events_12m"), "_owner_3m": F.sum("owner_events_3m")}
    size, year, quarter = F.col("_portfolio"), some("_owner_12m"), some("_owner_3m")
    columns = {"portfolio": size, "owner_events_12m": year, "owner_events_3m": quarter, "owner_rate_12m": guarded(year, size), "owner_rate_3m": guarded(quarter, size)}
    return Family(begun.unionByName(counts, allowMissingColumns=True), sums, columns | {"owner_rate_delta": columns["owner_rate_3m"] - columns["owner_rate_12m"]})


def owner_event_rate(entities: DataFrame, events: DataFrame, lo: str, hi: str) -> DataFrame:
    """(owner, obs) from the owner's first entity on, with the columns of ``owner_family``."""
    grid = key_grid(entities.where("owner is not null and first_date is not null"), ["owner"], lo, hi)
    return run_families(grid, ["owner"], [owner_family(entities, events, lo, hi)]).where("portfolio is not null")


def market_family(entities: DataFrame, lo: str, hi: str) -> Family:
    """Of each group: entities that exist and owners of any of them, from one row for each group, owner and month."""
    begun = _begun(entities.where("grp is not null and owner is not null"), ["grp", "owner"], lo, hi, "_begun")
    first = F.row_number().over(Window.partitionBy("grp", "owner").orderBy("obs")) == 1  # a row for each month at most
    changes = begun.withColumn("_owner", first.cast("int")).groupBy("grp", "obs").agg(F.sum("_begun").alias("_entities"), F.sum("_owner").alias("_owners"))
    return Family(changes, {"_e": F.sum("_entities"), "_o": F.sum("_owners")}, {"group_entities": F.col("_e"), "group_owners": F.col("_o")})


def own_entities(entities: DataFrame, lo: str, hi: str) -> DataFrame:
    """(grp, owner, obs, own_entities): entities of the owner in the group, from the first one on."""
    return _standing(entities.where("grp is not null and owner is not null"), ["grp", "owner"], lo, hi, "own_entities")


def market_structure(entities: DataFrame, lo: str, hi: str) -> tuple[DataFrame, DataFrame]:
    """(grp, obs, group_entities, group_owners) and (grp, owner, obs, own_entities): two levels, so a large group is counted owner by owner."""
    grid = key_grid(entities.where("grp is not null and owner is not null and first_date is not null"), ["grp"], lo, hi)
    total = run_families(grid, ["grp"], [market_family(entities, lo, hi)]).where("group_entities is not null")
    return total, own_entities(entities, lo, hi)


def group_family(events: DataFrame) -> Family:
    """Of each group: events in 12 months and how many are on."""
    grouped = events.where("grp is not null and start is not null")
    changes = id_deltas(grouped, ["grp"], [12], "_group").unionByName(deltas(grouped, ["grp"], {"_group_on": active_span()}), allowMissingColumns=True)
    return Family(changes, {"_g12": F.sum("_group_12m"), "_gon": F.sum("_group_on")}, {"_group_12m": F.col("_g12"), "_group_on": F.col("_gon")})


def group_activity(events: DataFrame, lo: str, hi: str) -> DataFrame:
    """(grp, obs): events of the group in 12 months and how many are on; months without any of them are left out."""
    grid = key_grid(events.where("grp is not null and start is not null"), ["grp"], lo, hi)
    return run_families(grid, ["grp"], [group_family(events)]).where("_group_12m > 0 or _group_on > 0")


def peers_of(df: DataFrame, groups: DataFrame, own_12m: str, own_now: str) -> DataFrame:
    """Adds peer_events_12m and peer_in_event_now: the group's events without one's own, and whether the group but not oneself is in one."""
    df = df.join(groups, ["grp", "obs"], "left")
    peers = F.greatest(F.coalesce("_group_12m", F.lit(0)) - F.coalesce(own_12m, F.lit(0)), F.lit(0))
    on = (F.coalesce("_group_on", F.lit(0)) > 0) & ~(F.coalesce(own_now, F.lit(0)) > 0)
    return df.withColumns({"peer_events_12m": peers, "peer_in_event_now": on.cast("int")}).drop("_group_12m", "_group_on")


def peer_events(spine: DataFrame, events: DataFrame, lo: str, hi: str) -> DataFrame:
    """(entity, obs): events of the group in 12 months without one's own, and whether the group but not oneself is in one.

    Group minus own stands for a join of the peers with each other.
    """
    own = own_history(spine, events, lo, hi, (12,), ("counts", "label"), ("grp",))
    return peers_of(own, settled(group_activity(events, lo, hi)), "events_12m", "in_event").select("entity", "obs", "peer_events_12m", "peer_in_event_now")


def latest_family(events: DataFrame, values: dict[str, str], ties: list[str]) -> Family:
    """Of each entity: columns {name: column} of its last event before obs, of equal starts the one with the greatest ties; null before the first one."""
    clean = events.where("entity is not null and start is not null")
    last = F.struct("start", *ties, *[F.col(c).alias(n) for n, c in values.items()])  # structs compare by start, then ties
    changes = deltas(clean, ["entity"], {}, {"_latest_max": (next_month(F.col("start")), last)})
    return Family(changes, {"_latest": F.max("_latest_max")}, {n: F.col("_latest")[n] for n in values})


def exit_family(exits: DataFrame, key: str, name: str, months: list[int], last: str | None = None) -> Family:
    """Of each key: exits by window, one's own included, and days since the last one."""
    dated = exits.where(F.col(key).isNotNull() & F.col("exit_date").isNotNull())
    points = {"_exit_max": (next_month(F.col("exit_date")), F.col("exit_date"))} if last else None
    changes = deltas(dated, [key], {f"_{name}_{n}": window_span(n, "exit_date") for n in months}, points)
    sums = {f"_{name}_{n}m": F.sum(f"_{name}_{n}") for n in months} | ({"_last_exit": F.max("_exit_max")} if last else {})
    return Family(changes, sums, {f"{name}_{n}m": some(f"_{name}_{n}m") for n in months} | ({last: F.datediff("obs", "_last_exit")} if last else {}))


def exit_signals(exits: DataFrame, spine: DataFrame, lo: str, hi: str) -> tuple[DataFrame, DataFrame]:
    """(grp, obs): exits in 12 and 36 months and days since the last; (owner, obs): exits in 12 months, months without any left out."""
    group = run_families(spine.where("grp is not null").select("grp", "obs").distinct(), ["grp"], [exit_family(exits, "grp", "group_exits", [12, 36], "days_since_group_exit")])
    grid = key_grid(exits.where("owner is not null and exit_date is not null"), ["owner"], lo, hi)
    return group, run_families(grid, ["owner"], [exit_family(exits, "owner", "owner_exits", [12])]).where("owner_exits_12m > 0")


def _type_points(flags: dict[str, str]) -> dict[str, tuple[Column, Column]]:
    return {f"_{k}_max": (F.lit(FIRST_MONTH).cast("date"), F.when(F.col("type") == v, 1).otherwise(0)) for k, v in flags.items()}


def coverage_family(coverage: DataFrame, flags: dict[str, str] | None = None) -> Family:
    """Of each entity: jurisdictions and benefit rows of coverage that is on, and whether any of its rows, whenever, is of a type.

    Of a jurisdiction's spans in the order of their first months each counts only beyond those before it.
    """
    first, last = active_span()
    flags = flags or {}
    rows = coverage.where("entity is not null").select("entity", "jurisdiction", "benefit", *(["type"] if flags else []), first.alias("_a"), last.alias("_b"))
    rows = rows if flags else rows.where("_a <= _b")
    w = Window.partitionBy("entity", "jurisdiction").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("_a") <= F.col("_b"), F.col("_b"))).over(w)
    rows = rows.withColumn("_from", F.greatest("_a", F.add_months(before, 1)))
    spans = {"_places": (F.when(F.col("jurisdiction").isNotNull(), F.col("_from")), F.col("_b")), "_benefit": (F.when(F.col("benefit"), F.col("_a")), F.col("_b"))}
    sums = {"_p": F.sum("_places"), "_q": F.sum("_benefit")} | {f"_{k}": F.max(f"_{k}_max") for k in flags}
    return Family(deltas(rows, ["entity"], spans, _type_points(flags)), sums, {"n_jurisdictions": some("_p"), "n_benefit_rows": some("_q")} | {k: some(f"_{k}") for k in flags})


def type_family(coverage: DataFrame, flags: dict[str, str]) -> Family:
    """The type flags of ``coverage_family`` alone: a row for each entity."""
    changes = deltas(coverage.where("entity is not null").select("entity", "type"), ["entity"], {}, _type_points(flags))
    return Family(changes, {f"_{k}": F.max(f"_{k}_max") for k in flags}, {k: some(f"_{k}") for k in flags})


def coverage_breadth(spine: DataFrame, coverage: DataFrame, lo: str, hi: str) -> DataFrame:
    """(entity, obs): jurisdictions and benefit rows of coverage that is on at obs."""
    return run_families(spine, ["entity"], [coverage_family(coverage)])


def static_type_flags(coverage: DataFrame, col: str, flags: dict[str, str]) -> DataFrame:
    """One row for each entity: whether any of its rows is of a type."""
    return coverage.groupBy("entity").agg(*[F.max(F.when(F.col(col) == v, 1).otherwise(0)).alias(k) for k, v in flags.items()])


def entity_age_years(first: Column, obs: Column) -> Column:
    return F.datediff(obs, first).cast("double") / F.lit(AGE_DAYS)


def token_changes(foreign: DataFrame) -> DataFrame:
    """(token, obs, _on, _new, _ever): +1 in a month from which a token has an event on (or one begun in 12 months), -1 where that ends.

    The union of a token's spans: its running counts over the months in which they change, of which only
    the steps from none to some and back are kept.
    """
    # begun before obs and not ended before it: an end on obs is still on
    still = foreign.where("token is not null").select("token", F.date_add("start", 1).alias("start"), F.date_add("end", 1).alias("end"), F.col("start").alias("_s"))
    changes = deltas(still, ["token"], {"_on": active_span(), "_new": window_span(12, "_s")}, {"_ever_max": (F.lit(FIRST_MONTH).cast("date"), F.lit(1))})
    w = Window.partitionBy("token").orderBy("obs")  # a row for each month at most
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = {c: (F.coalesce(F.sum(c).over(upto), F.lit(0)) > 0).cast("int") for c in ("_on", "_new")}
    steps = changes.select("token", "obs", "_ever_max", *[x.alias(c) for c, x in some.items()])
    steps = steps.select("token", "obs", F.coalesce("_ever_max", F.lit(0)).alias("_ever"), *[(F.col(c) - F.lag(c, 1, 0).over(w)).alias(c) for c in some])
    return steps.where("_ever > 0 or _on <> 0 or _new <> 0")


def token_family(entity_tokens: DataFrame, foreign: DataFrame, hi: str) -> Family:
    """Of each entity: ever matched, distinct tokens with a foreign event on, distinct tokens with one begun in 12 months.

    Only the months in which a token's signals begin or end go through the bridge, not each month of them.
    """
    bridge = entity_tokens.where("entity is not null").select("entity", "token").distinct()
    met = bridge.join(token_changes(foreign).where(F.col("obs") <= F.lit(hi).cast("date")), "token")
    changes = met.groupBy("entity", "obs").agg(F.sum("_ever").alias("_token_ever"), F.sum("_on").alias("_token_on"), F.sum("_new").alias("_token_new"))
    sums = {"_match": F.sum("_token_ever"), "_active": F.sum("_token_on"), "_begun": F.sum("_token_new")}
    return Family(changes, sums, {"foreign_match": (some("_match") > 0).cast("int"), "foreign_active": some("_active"), "foreign_12m": some("_begun")})


def token_bridge_signals(spine: DataFrame, entity_tokens: DataFrame, foreign: DataFrame, lo: str, hi: str) -> DataFrame:
    """(entity, obs) with the columns of ``token_family``."""
    return run_families(spine, ["entity"], [token_family(entity_tokens, foreign, hi)])


def event_measures(events: DataFrame, anticipated: str, actual: str, estimated_end: str, actual_end: str) -> DataFrame:
    """Duration (null if ended before it began), lead time, error of the estimated end, and whether the dates are suspect."""
    return events.withColumns({
        "duration_days": F.when(F.col(actual_end) >= F.col(actual), F.datediff(actual_end, actual)),
        "lead_days": F.datediff(actual, anticipated),
        "estimate_error_days": F.datediff(actual_end, estimated_end),
        "suspect_dates": F.col(actual_end) < F.col(actual),
    })
