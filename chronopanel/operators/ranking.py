"""Ranking metrics over scored rows (keys, entity, label, score). Ties break on the entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sums
from .quantiles import quantiles
from .windows import average_ranks


def tag_strata(df: DataFrame, train_entities: DataFrame, history: str, class_col: str, classes: list[str]) -> DataFrame:
    """One row for each overlapping stratum of a row: overall, warm or cold, seen or unseen, its class or other."""
    seen = train_entities.select(F.col("entity").alias("_e")).distinct()
    df = df.join(seen, df["entity"] == seen["_e"], "left")
    known = F.col(class_col).isin(classes)
    tags = F.array(
        F.lit("overall"), F.when(F.col(history) > 0, "warm").otherwise("cold"), F.when(F.col("_e").isNotNull(), "seen").otherwise("unseen"),
        F.when(known, F.concat(F.lit("class_"), F.col(class_col))).otherwise(F.lit("class_other")),
    )
    return df.withColumn("stratum", F.explode(tags)).drop("_e")


def topk(df: DataFrame, keys: list[str], k: int, score: str = "score", ties: str = "entity") -> DataFrame:
    """The k highest rows of each key, with their rank; groups are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def global_topk(df: DataFrame, k: int, score: str = "score", ties: str = "entity") -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), ties).limit(k)


def precision_at_k(df: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """n, positives, hits and precision among the top k; no precision for a key of fewer rows or of one class."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))
    return with_precision(sizes, top_hits(df, keys, ks), keys, ks)


def top_hits(df: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    return topk(df, keys, max(ks)).groupBy(*keys).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).cast("bigint").alias(f"hits_{k}") for k in ks])


def with_precision(sizes: DataFrame, hits: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return sizes.join(hits, keys).withColumns({f"p_at_{k}": F.when(both & (F.col("n") >= k), F.col(f"hits_{k}") / F.lit(float(k))) for k in ks})


def _curve(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Of each distinct score its rows and positives (_n, _p), those up to and with it (_n_to, _p_to) and the key's (.._total).

    The sums run by ranges of (key, score): a stratum of all rows, each with a score of its own, is spread over all tasks.
    """
    return _along(df.groupBy(*keys, "score").agg(F.count("*").alias("_n"), F.sum("label").cast("bigint").alias("_p"), *more), keys)


def _along(steps: DataFrame, keys: list[str]) -> DataFrame:
    return running_sums(steps, keys, ["score"], {"_n_to": F.col("_n"), "_p_to": F.col("_p")}, totals=True)


#: Of the rows and positives of a score: negatives below each positive and half of those beside it; precision from there up.
_BELOW = "_p * (_n_to - _p_to - (_n - _p) / 2.0D)"
_PRECISION = "_p * (_p_to_total - _p_to + _p) / cast(_n_to_total - _n_to + _n as double)"


def _areas() -> tuple[Column, Column]:
    """ROC area (Mann-Whitney) and average precision over falling distinct scores of summed steps; null with one class."""
    both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("_rows"))
    roc = F.when(both, F.col("_won") / (F.col("_pos").cast("double") * (F.col("_rows") - F.col("_pos"))))
    return roc.alias("roc_auc"), F.when(both, F.col("_ap") / F.col("_pos")).alias("pr_auc")


def _summed(steps: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return steps.groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.sum("_p").alias("_pos"), F.sum(F.expr(_BELOW)).alias("_won"), F.sum(F.expr(_PRECISION)).alias("_ap"), *more)


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney statistic, ties counted half; null with one class."""
    return _summed(_curve(df, keys), keys).select(*keys, _areas()[0])


def pr_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision: the sum of precision times the gain in recall over falling distinct scores; null with one class."""
    return _summed(_curve(df, keys), keys).select(*keys, _areas()[1])


def pr_auc_of_counts(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``pr_auc`` of rows that are counted already: keys, distinct score, its rows (_n) and positives (_p)."""
    return _summed(_along(steps, keys), keys).select(*keys, _areas()[1])


def brier(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))


def compute_metrics(df: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """n, positives, base rate, precision at k, ROC and PR area, Brier score of each key; areas and precision are null with one class.

    All but the top k comes from one pass over counts by score.
    """
    error = (F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))
    sums = _summed(_curve(df, keys, F.sum(error).alias("_e")), keys, F.sum("_e").alias("_err"))
    sums = with_precision(sums.withColumns({"n": F.col("_rows"), "positives": F.col("_pos")}), top_hits(df, keys, ks), keys, ks)
    return sums.select(*keys, "n", "positives", *[f"p_at_{k}" for k in ks], (F.col("positives") / F.col("n")).alias("base_rate"), *_areas(), (F.col("_err") / F.col("n")).alias("brier"))


def heuristic_single(col: str, *keys: str) -> Column:
    """A count, its many ties broken by the keys."""
    return F.col(col).cast("double") + jitter(*keys, scale=1e-6)


def heuristic_compound(prior: str, rate: str, *keys: str, weight: float = 0.01) -> Column:
    """A count, then a rate, then the keys."""
    return F.col(prior).cast("double") + F.lit(weight) * F.col(rate) + jitter(*keys)


def jitter(*keys: str, seed: int = 0, scale: float = 1e-9) -> Column:
    """A tiny reproducible tie-break from a hash of the keys, whatever the order of the rows."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.lit(scale) * (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)))


def blend_scores(df: DataFrame, keys: list[str], first: str, second: str, w1: float = 2.0, w2: float = 1.0, out: str = "blend") -> DataFrame:
    """Weighted sum of the mean ranks of two scores within each key."""
    df = average_ranks(df, keys, {first: "_r1", second: "_r2"})
    return df.withColumn(out, F.lit(w1) * F.col("_r1") + F.lit(w2) * F.col("_r2")).drop("_r1", "_r2")


def per_month_topk(df: DataFrame, ks: list[int]) -> DataFrame:
    """Long form (ranker, obs, k, n, positives, hits, precision) of rows (ranker, obs, entity, label, score)."""
    wide = precision_at_k(df, ["ranker", "obs"], ks)
    stack = ", ".join(f"{k}, hits_{k}, p_at_{k}" for k in ks)
    return wide.selectExpr("ranker", "obs", "n", "positives", f"stack({len(ks)}, {stack}) as (k, hits, p_at_k)")


def summarize_topk(monthly: DataFrame) -> DataFrame:
    """Mean, median, least and greatest precision over months, mean hits, lift over the mean base rate."""
    df = monthly.groupBy("ranker", "k").agg(
        F.avg("p_at_k").alias("mean_p"), F.median("p_at_k").alias("median_p"), F.min("p_at_k").alias("min_p"), F.max("p_at_k").alias("max_p"),
        F.avg("hits").alias("mean_hits"), F.avg(F.col("positives") / F.col("n")).alias("base_rate"),
    )
    return df.withColumn("lift", F.try_divide("mean_p", "base_rate"))


def compare_rankers(monthly: DataFrame, k: int, rankers: list[str]) -> DataFrame:
    """Hits of each ranker side by side, month by month."""
    return monthly.where(F.col("k") == k).groupBy("obs").pivot("ranker", rankers).agg(F.first("hits"))


def relative_lift(summary: DataFrame, k: int, ranker: str, base: str) -> DataFrame:
    """Relative gain in mean precision of a ranker over another; null where that is 0."""
    row = summary.where(F.col("k") == k).agg(F.max(F.when(F.col("ranker") == ranker, F.col("mean_p"))).alias("p"), F.max(F.when(F.col("ranker") == base, F.col("mean_p"))).alias("p_base"))
    return row.withColumn("gain", F.try_divide(F.col("p") - F.col("p_base"), F.col("p_base")))


def _edges(df: DataFrame, bins: int) -> DataFrame:
    """One row: distinct ascending quantiles of the score."""
    points = {f"_e{i}": i / bins for i in range(bins + 1)}
    return quantiles(df, [], "score", points).select(F.array_sort(F.array_distinct(F.array(*points))).alias("_edges"))


def score_bins(df: DataFrame, bins: int) -> DataFrame:
    """Adds bin, from 0: right-closed buckets between the score's quantiles, of which equal ones merge; the lowest value is in bin 0."""
    joined = df.crossJoin(F.broadcast(_edges(df, bins)))  # one row
    upper = F.filter(F.slice("_edges", 2, bins), lambda e: e < F.col("score"))
    return joined.withColumn("bin", F.size(upper)).drop("_edges")


def reliability_table(df: DataFrame, bins: int = 20) -> DataFrame:
    return score_bins(df, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("positive_rate"))


def decile_capture(df: DataFrame) -> DataFrame:
    """Positives in the lowest, the three lowest and the highest score decile."""
    tens = score_bins(df, 10)
    top = F.max("bin").over(Window.partitionBy(F.lit(1)))
    counts = tens.groupBy("bin").agg(F.sum("label").cast("bigint").alias("p")).withColumn("_top", top)
    return counts.agg(F.sum("p").alias("positives"), F.sum(F.when(F.col("bin") == 0, F.col("p")).otherwise(0)).alias("bottom"), F.sum(F.when(F.col("bin") < 3, F.col("p")).otherwise(0)).alias("bottom_3"), F.sum(F.when(F.col("bin") == F.col("_top"), F.col("p")).otherwise(0)).alias("top"))


def fixed_buckets(col: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bucket (a, b] that a value is in; null outside all."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((col > low) & (col <= high), F.lit(label)).otherwise(out)
    return out


def group_pr_auc(df: DataFrame, col: str, min_n: int, min_pos: int = 5) -> DataFrame:
    """PR area and lift of each subgroup that is large enough."""
    sizes = df.groupBy(col).agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives")).where((F.col("n") >= min_n) & (F.col("positives") >= min_pos))
    out = sizes.join(pr_auc(df, [col]), col).withColumn("base_rate", F.col("positives") / F.col("n"))
    return out.withColumn("lift", F.col("pr_auc") / F.col("base_rate"))


def worst_misses(df: DataFrame, k: int) -> DataFrame:
    """Positives with the lowest scores."""
    return df.where("label = 1").orderBy("score", "entity", "obs").limit(k)


def confident_false_positives(df: DataFrame, k: int) -> DataFrame:
    return df.where("label = 0").orderBy(F.col("score").desc(), "entity", "obs").limit(k)


def missed_by_entity(df: DataFrame, threshold: float, k: int) -> DataFrame:
    """Entities with the most positives scored below the threshold."""
    return df.where((F.col("label") == 1) & (F.col("score") < threshold)).groupBy("entity").agg(F.count("*").alias("misses"), F.max("score").alias("best_score")).orderBy(F.col("misses").desc(), "entity").limit(k)


def top_picks(df: DataFrame, names: DataFrame, k: int, cold: str | None = None) -> DataFrame:
    """The latest month's k highest rows with names; with ``cold``, only rows whose history count is 0."""
    last = df.agg(F.max("obs").alias("obs"))
    rows = df.join(F.broadcast(last), "obs")  # one row
    rows = rows if cold is None else rows.where(F.col(cold) == 0)
    best = rows.orderBy(F.col("score").desc(), "entity").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "entity")))
    return ranked.join(names.groupBy("entity").agg(F.min("name").alias("name")), "entity", "left")
