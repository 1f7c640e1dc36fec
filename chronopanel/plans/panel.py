"""The panel: labels and as-of features on the (entity, month) spine, its splits, scores and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.ranking import blend_scores, heuristic_compound, heuristic_single
from ..operators.staging import settled
from ..sources.io import write_table
from .models import BOOLEAN, CATEGORICAL, NUMERIC
from .proxy import HI, LO, SPLITS, Tables


def labelled_spine(t: Tables, lo: str = LO, hi: str = HI) -> DataFrame:
    return H.forward_label(H.entity_spans(t.entities(), lo, hi), t.events(), lo, hi)


#: Categories of an entity beside its owner; with the nation of its last reporter these are the models' five.
CATEGORIES = ("type", "size_band", "kind")


#: Families of an entity that no model reads: coverage breadth and outside signals.
BREADTH = ("n_jurisdictions", "n_benefit_rows")
SIGNALS = ("foreign_match", "foreign_active", "foreign_12m")


def assemble_features(t: Tables, categories: bool = False, signals: bool = True) -> DataFrame:
    """All feature families, and in_event and label, on the spine, whose rows stay one to one.

    Entities and events, both narrow, are settled once. What belongs to the entity (own
    events, label, coverage, outside signals) is one list of changes under one
    running window, and so is what belongs to the owner and to the group; those are a row for each key and
    month, settled, so that Spark knows their size before it joins them and moves the spine for none that is small.
    With ``categories`` also the four beside the owner: type, size band and kind of the part, nation of its
    last reporter before obs (null: none yet). Without ``signals`` neither coverage breadth nor outside signals are made; all else is the same.
    """
    also = CATEGORIES if categories else ()
    entities, events = settled(t.entities(categories)), settled(t.events())
    grid, exits = H.entity_spans(entities, LO, HI, also), t.exits()
    flags = {"is_generic": "F", "is_brand": "O"}
    own = [H.own_family(events, families=(*H.FAMILIES, "label"), reach=(LO, HI))]
    own += [H.coverage_family(t.coverage(), flags), H.token_family(t.entity_tokens(), t.foreign_events(), HI)] if signals else [H.type_family(t.coverage(), flags)]
    own += [H.latest_family(events.join(t.nations(), "reporter", "left"), {"last_nation": "nation"}, ["event_id"])] if categories else []
    df = H.run_families(grid, ["entity"], own, ("code", "owner", "grp", "first_date", *also))
    calendar = lambda key: H.key_grid(entities.where(F.col(key).isNotNull()), [key], LO, HI)
    owners = settled(H.run_families(calendar("owner"), ["owner"], [H.owner_family(entities, events, LO, HI), H.exit_family(exits, "owner", "owner_exits", [12])]), "owners")
    groups = settled(H.run_families(calendar("grp"), ["grp"], [H.market_family(entities, LO, HI), H.group_family(events), H.exit_family(exits, "grp", "group_exits", [12, 36], "days_since_group_exit")]), "groups")
    shares = settled(H.own_entities(entities, LO, HI), "shares")
    df = H.peers_of(df, groups, "events_12m", "in_event").join(owners, ["owner", "obs"], "left").join(shares, ["grp", "owner", "obs"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.select(
        "obs", "entity", "code", "owner", "grp", "in_event", "label", H.entity_age_years(F.col("first_date"), F.col("obs")).alias("age_years"),
        "events_12m", "events_36m", "events_all", "was_ever", "days_since_last", "days_since_first", "longest_days", "mean_gap_days", "overdue_days",
        zero("portfolio").alias("portfolio"), zero("owner_events_12m").alias("owner_events_12m"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("owner_rate_12m", "owner_rate_3m", "owner_rate_delta")],
        zero(F.col("group_entities") - 1).alias("competing"), zero("group_owners").alias("group_owners"), H.guarded(F.col("own_entities"), F.col("group_entities")).alias("own_share"),
        "peer_events_12m", "peer_in_event_now", zero("group_exits_12m").alias("group_exits_12m"), zero("group_exits_36m").alias("group_exits_36m"), "days_since_group_exit",
        zero("owner_exits_12m").alias("owner_exits_12m"), H.guarded(F.col("owner_exits_12m"), F.col("portfolio")).alias("owner_exit_rate_12m"),
        *(BREADTH if signals else ()), "is_generic", "is_brand", *(SIGNALS if signals else ()),
        *(also + ("last_nation",) if categories else ()),
    )


def build_panel(t: Tables, stamp: bool = False, categories: bool = False, signals: bool = True) -> DataFrame:
    panel = assemble_features(t, categories, signals)
    return panel.withColumn("loaded_at", F.current_timestamp()) if stamp else panel


def modelled(t: Tables) -> DataFrame:
    """Rows of the splits with what the models read and no more, settled: fits and predictions go over them many times, and the panel is built once."""
    df = exclude_and_split(build_panel(t, categories=True, signals=False))
    return settled(df.select("obs", "entity", "label", "split", *NUMERIC, *BOOLEAN, *CATEGORICAL), "modelled")


def write_by_month(panel: DataFrame, path: str) -> None:
    """The panel as a table partitioned by month, so that a split reads its own months alone; a few files for each, and a large month is no one task's work."""
    write_table(panel.hint("rebalance", "obs"), path, ["obs"])


def exclude_and_split(panel: DataFrame, splits: dict[str, tuple[str, str]] = SPLITS) -> DataFrame:
    """Rows not in an event, tagged with their split; the buffers between splits belong to none.

    Filters on obs and in_event reach the scan, and prune partitions if the panel is partitioned by obs.
    """
    tag = F.lit(None).cast("string")
    for name, (a, b) in splits.items():
        tag = F.when(F.col("obs").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(name)).otherwise(tag)
    return panel.where("in_event = 0").drop("in_event").withColumn("split", tag).where("split is not null")


def split_summary(tagged: DataFrame) -> DataFrame:
    """Rows, positives, rate, entities and months (as many as the calendar has at most, so kept as a set) of each split."""
    return tagged.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum("label").cast("bigint").alias("positives"), F.round(F.avg("label"), 9).alias("rate"), F.countDistinct("entity").alias("entities"),
        F.size(F.collect_set("obs")).cast("bigint").alias("months"), F.min("obs").alias("first_obs"), F.max("obs").alias("last_obs"), F.count_if(F.col("label").isNull()).alias("null_labels"),
    )


def short_panel(t: Tables, lo: str = LO, hi: str = HI) -> DataFrame:
    """What the ranking queries need, for some months: label, own counts and owner rate. All history before them is read."""
    entities, events = t.entities(), t.events()
    own = H.own_history(H.entity_spans(entities, lo, hi), events, lo, hi, families=("counts", "label"), keep=("code", "owner", "grp", "first_date"))
    owner = settled(H.owner_event_rate(entities, events, lo, hi).select("owner", "obs", "owner_rate_12m"), "owners")
    return own.join(owner, ["owner", "obs"], "left").fillna(0.0, ["owner_rate_12m"])


def scored(t: Tables, split: str = "test") -> DataFrame:
    """Rows of a split with two heuristic scores and one between 0 and 1, settled: every metric reads them more than once."""
    df = exclude_and_split(short_panel(t, *SPLITS[split]), {split: SPLITS[split]})
    df = df.withColumns({"single": heuristic_single("events_12m", "entity", "obs"), "compound": heuristic_compound("events_12m", "owner_rate_12m", "entity", "obs")})
    return settled(df.withColumn("score", F.col("compound") / (F.col("compound") + 4)))


def blended(t: Tables, split: str = "test") -> DataFrame:
    """The scored rows with the blend of both heuristics' ranks in their month, settled."""
    return settled(blend_scores(scored(t, split), ["obs"], "compound", "single"))


def ranked_long(t: Tables) -> DataFrame:
    """(ranker, obs, entity, label, score): all rankers in one frame, so one window serves them."""
    df = blended(t)
    return df.selectExpr("obs", "entity", "label", "stack(3, 'single', single, 'compound', compound, 'blend', blend) as (ranker, score)")
