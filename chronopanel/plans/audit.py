"""Audit reports over staged tables: one DataFrame each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import anti, overlap_counts
from ..operators.quantiles import quantiles
from ..operators.windows import concentration


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct ids, ids that occur more than once, and the rows they have."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.count_if(F.col("n") > 1).alias("dup_ids"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("dup_rows"))


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """The rows whose id occurs more than once."""
    many = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return df.join(many, key)


def same_start(events: DataFrame) -> DataFrame:
    return events.groupBy("entity", "start").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids")).where("n > 1")


def overlaps(events: DataFrame) -> DataFrame:
    """Overlapping pairs and entities that have them, counted without making the pairs."""
    return overlap_counts(events).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.count("*").alias("entities"))


def missing_from_dimension(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Ids in the events, ids without a dimension row, and rows these have."""
    gone = anti(events, dimension, key)
    left = events.agg(F.countDistinct(key).alias("ids"), F.count("*").alias("n_rows"))
    return left.crossJoin(gone.agg(F.countDistinct(key).alias("missing_ids"), F.count("*").alias("missing_rows")))  # one row each


def after_cancellation(events: DataFrame, entities: DataFrame) -> DataFrame:
    late = events.join(entities.where(F.col("status").startswith("CANCELLED")).select("entity", "status_date"), "entity").where("start > status_date")
    return late.agg(F.count("*").alias("events"), F.countDistinct("entity").alias("entities"), F.round(F.avg(F.datediff("start", "status_date")), 6).alias("mean_days"))


def per_month(events: DataFrame, date: str = "start") -> DataFrame:
    return events.groupBy(F.trunc(date, "month").alias("month")).agg(F.count("*").alias("n"))


def lag_percentiles(df: DataFrame, lag: str) -> DataFrame:
    sums = df.agg(F.count(lag).alias("n"), F.round(F.avg(lag), 6).alias("mean"), F.min(lag).alias("least"), F.max(lag).alias("most"), F.count_if(F.col(lag) < 0).alias("negative"))
    return sums.crossJoin(quantiles(df, [], lag, {"p50": 0.5, "p95": 0.95}))  # one row each


def late_share(df: DataFrame, date: str, lag: str, limit: int) -> DataFrame:
    out = df.groupBy(F.trunc(date, "month").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col(lag) > limit).alias("late"))
    return out.withColumn("late_percent", F.round(100.0 * F.col("late") / F.col("n"), 4))


def several_statuses(df: DataFrame, key: str, status: str, attribute: str) -> DataFrame:
    """Keys with several statuses: which, and whether another attribute agrees.

    Equal rows are put together before they are moved, so a key moves a row for each of its pairs of values and is not copied for each distinct count.
    """
    pairs = df.groupBy(F.col(key), F.col(status).alias("_s"), F.col(attribute).alias("_a")).agg(F.lit(1).alias("_one"))
    out = pairs.groupBy(key).agg(F.array_sort(F.collect_set("_s")).alias("_all"), F.min("_a").alias("_least"), F.max("_a").alias("_most"))
    out = out.where(F.size("_all") > 1).groupBy(F.array_join("_all", " + ").alias("combo"))
    return out.agg(F.count("*").alias("n_keys"), F.count_if(F.col("_least") < F.col("_most")).alias("inconsistent"))


def exit_shape(exits: DataFrame, entities: DataFrame) -> DataFrame:
    joined = exits.join(entities.select("entity", "status"), "entity", "left")
    return joined.agg(F.count("*").alias("n_rows"), F.countDistinct("entity").alias("entities"), F.expr("count(distinct entity) filter (where status like 'CANCELLED%')").alias("cancelled"), F.min("exit_date").alias("first_exit"), F.max("exit_date").alias("last_exit"))


def event_then_exit(events: DataFrame, exits: DataFrame) -> DataFrame:
    """Entities with both: how often the first event comes before the first exit, and mean days between."""
    e = events.groupBy("entity").agg(F.min("start").alias("s"))
    x = exits.groupBy("entity").agg(F.min("exit_date").alias("x"))
    return e.join(x, "entity").agg(F.count("*").alias("both"), F.count_if(F.col("s") < F.col("x")).alias("event_first"), F.round(F.avg(F.when(F.col("s") < F.col("x"), F.datediff("x", "s"))), 6).alias("mean_days"))


def owner_stability(df: DataFrame, code: str, name: str) -> DataFrame:
    """Codes with several names and names with several codes."""
    pairs = df.select(code, name).distinct()
    a = pairs.groupBy(code).agg(F.count("*").alias("n")).agg(F.count("*").alias("codes"), F.count_if(F.col("n") > 1).alias("codes_many_names"))
    b = pairs.groupBy(name).agg(F.count("*").alias("n")).agg(F.count("*").alias("names"), F.count_if(F.col("n") > 1).alias("names_many_codes"))
    return a.crossJoin(b)  # one row each


def date_patterns(events: DataFrame, today: str) -> DataFrame:
    return events.agg(
        F.count("*").alias("n_rows"), F.count("start").alias("with_start"), F.count("end").alias("with_end"), F.count_if(F.col("start").isNotNull() & F.col("end").isNull()).alias("open"),
        F.count_if(F.col("start") > F.lit(today).cast("date")).alias("future_start"), F.count_if(F.col("end") < F.col("start")).alias("inverted"),
    )


def lifetime_distribution(events: DataFrame) -> DataFrame:
    per = events.groupBy("entity").agg(F.countDistinct("event_id").alias("n"))
    sums = per.agg(F.count("*").alias("entities"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))
    return sums.crossJoin(quantiles(per, [], "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}))  # one row each


def label_crosstab(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("in_event") == 1).alias("excluded"), F.count_if((F.col("label") == 1) & (F.col("in_event") == 1)).alias("both"))


def positive_concentration(panel: DataFrame, ns: list[int]) -> DataFrame:
    return concentration(panel, "entity", F.col("label"), ns)


def extremes(rates: DataFrame, k: int) -> DataFrame:
    """The owners and months of the highest rates."""
    return rates.orderBy(F.col("owner_rate_12m").desc(), "owner", "obs").limit(k)


def positives_per_entity(panel: DataFrame) -> DataFrame:
    per = panel.groupBy("entity").agg(F.sum("label").cast("bigint").alias("n"))
    sums = per.agg(F.count("*").alias("entities"), F.count_if(F.col("n") == 0).alias("without"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))
    return sums.crossJoin(quantiles(per, [], "n", {"p50": 0.5, "p95": 0.95}))  # one row each


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), col).limit(k)


def source_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("source"), "n_rows") for name, df in tables.items()])


def tables_by_schema(spark: SparkSession) -> DataFrame:
    """Tables and views of each database of the catalog."""
    found = [(db.name, len(spark.catalog.listTables(db.name))) for db in spark.catalog.listDatabases()]
    return spark.createDataFrame(found, "schema string, n_tables int")


def schema_counts(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Tables of each schema and the rows that they have in all."""
    each = [df.agg(F.count("*").alias("n_rows")).select(F.lit(schema).alias("schema"), "n_rows") for (schema, _), df in tables.items()]
    return reduce(DataFrame.unionByName, each).groupBy("schema").agg(F.count("*").alias("n_tables"), F.sum("n_rows").alias("n_rows"))


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null values of all columns, in one pass."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in cols])


