"""Window helpers with an explicit order, nulls last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sums


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Give an order without ties; the rest of the group is pruned before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_by(df: DataFrame, keys: list[str], date: str, ties: list[str], where: Column | None = None) -> DataFrame:
    return dedupe_first(df if where is None else df.where(where), keys, [F.col(date).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]])


def prefer(df: DataFrame, keys: list[str], col: str, ranking: list[str], ties: list[str]) -> DataFrame:
    """The row whose value comes first in a list of preferred values; other values come after, null last."""
    place = F.coalesce(*[F.when(F.col(col) == v, F.lit(i)) for i, v in enumerate(ranking)], F.when(F.col(col).isNotNull(), F.lit(len(ranking))), F.lit(len(ranking) + 1))
    return dedupe_first(df, keys, [place, *[F.col(t).asc_nulls_last() for t in ties]])


def lag_gap(df: DataFrame, keys: list[str], date: str, ties: list[str], out: str = "gap") -> DataFrame:
    """Days since the previous row of the key."""
    w = Window.partitionBy(*keys).orderBy(date, *ties)
    return df.withColumn(out, F.datediff(date, F.lag(date).over(w)))


def average_ranks(df: DataFrame, keys: list[str], scores: dict[str, str]) -> DataFrame:
    """Adds for each score {column: name} its ascending rank inside the key from 1, null scores first, NaN last; ties share their mean.

    Ranks come from counts of distinct scores under running sums by ranges of (key,
    score), so no task sorts more than a range of a key, whether its scores tie or
    not. All scores, which are of one type, go through one pass.
    """
    each = [df.select(*keys, F.lit(i).alias("_which"), F.col(f"`{c}`").alias("_score")) for i, c in enumerate(scores)]
    steps = reduce(DataFrame.unionAll, each).groupBy(*keys, "_which", "_score").agg(F.count("*").alias("_n"))
    steps = running_sums(steps, [*keys, "_which"], ["_score"], {"_to": F.col("_n")})
    names = {k: f"_r_{i}" for i, k in enumerate(keys)}
    for i, (score, out) in enumerate(scores.items()):
        own = steps.where(F.col("_which") == i).select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], F.col("_score").alias("_of"), (F.col("_to") - (F.col("_n") - 1) / F.lit(2.0)).alias(out))
        on = df[score].eqNullSafe(own["_of"])
        for k, n in names.items():
            on &= df[k].eqNullSafe(own[n])
        df = df.join(own, on, "left").drop("_of", *names.values())
    return df


def average_rank(df: DataFrame, keys: list[str], score: str, out: str = "rank") -> DataFrame:
    """One score's rank as ``average_ranks`` gives it."""
    return average_ranks(df, keys, {score: out})


def numbered(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Row numbers from 1 of an already small table, such as a top list."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def concentration(df: DataFrame, entity: str, value: Column, ns: list[int]) -> DataFrame:
    """Share of the positives that the top n entities hold, for each n. Ranks run on one row for each entity."""
    per = df.groupBy(entity).agg(F.sum(value).alias("_v"))
    total = per.agg(F.sum("_v").alias("_total"), F.count_if(F.col("_v") > 0).alias("entities_with_positives"))
    tops = per.orderBy(F.col("_v").desc(), F.col(entity)).limit(max(ns))
    ranked = numbered(tops, [F.col("_v").desc(), F.col(entity)], "_rn")
    sums = ranked.agg(*[F.sum(F.when(F.col("_rn") <= n, F.col("_v"))).alias(f"top_{n}") for n in ns])
    out = sums.crossJoin(total)  # one row each
    stack = ", ".join(f"{n}, top_{n}" for n in ns)
    out = out.selectExpr(f"stack({len(ns)}, {stack}) as (top_n, positives)", "_total as total", "entities_with_positives")
    return out.withColumn("share", F.col("positives") / F.col("total"))
