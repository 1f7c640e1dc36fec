"""Hard negatives by exact integer inner products, several candidates to one multiplication.

Components are whole numbers. The d-th components of a few candidates, made
non-negative by a bias, are put side by side into separate fields of one wide
integer; multiplied by an anchor's d-th component and summed over d, each field
holds one candidate's product sum, which no carry leaves as the fields are wide
enough for the largest possible sum. Integers under 2**53 are exact as doubles, so
a block of anchors meets a block of packed candidates in one matrix product; wider
ones are Python's own integers.

Anchors are a stated query set, met with all rows in blocks: a pass over the
blocks finds each anchor's best rows of its label, a second one the best rows of
other labels below those. A block gives a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Components in a block of candidates and of anchors (65536 and 8192 rows of 64), at most but for chance and for a
#: single row, whatever the vectors' length; the least rows of a block that is made for the sake of more tasks.
CANDIDATES, ANCHORS, LEAST = 1 << 22, 1 << 19, 2048
#: Scores held at once, and bits of a double that hold whole numbers exactly.
SCORES, EXACT_BITS = 1 << 21, 53
#: Candidates in one of Python's integers.
WIDE_FIELDS = 32
NO_SCORE = np.iinfo(np.int64).min


def pack(candidates: np.ndarray, bias: int, width: int, fields: int) -> np.ndarray:
    """(rows, dims) of at least -bias to (dims, lanes): lane l has the biased rows l * fields, l * fields + 1, ... from the low bits up."""
    rows, dims = candidates.shape
    lanes = -(-rows // fields)
    kind = object if width * fields > EXACT_BITS else np.int64
    biased = np.zeros((lanes * fields, dims), kind)
    biased[:rows] = candidates.astype(kind) + bias
    wide = np.zeros((lanes, dims), kind)
    for f in range(fields):
        wide += biased[f::fields] * (1 << (width * f))
    return wide.T if kind is object else wide.T.astype(np.float64)


def products(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of anchors with their exact scores (int64) against all candidates."""
    bias = max(0, -int(candidates.min(initial=0)))
    top = bias + int(candidates.max(initial=0))
    most = top * max((int(np.abs(a.astype(object)).sum()) for a in anchors), default=0)  # no field's sum is farther from 0
    width = (2 * most).bit_length()
    fields = max(1, EXACT_BITS // max(1, width))
    if fields == 1:  # no two fields in a double
        fields = WIDE_FIELDS
    wide = pack(candidates, bias, width, fields)
    lift, mask = sum(most << (width * f) for f in range(fields)), (1 << width) - 1
    step = max(1, SCORES // max(1, len(candidates)))
    for at in range(0, len(anchors), step):
        some = anchors[at : at + step].astype(wide.dtype)
        sums = np.dot(some, wide) + lift  # every field is 0 or more now
        sums = sums if wide.dtype == object else sums.astype(np.int64)
        out = np.empty((len(some), wide.shape[1] * fields), wide.dtype if wide.dtype == object else np.int64)
        for f in range(fields):
            out[:, f::fields] = ((sums >> (width * f)) & mask) - most
        out = out[:, : len(candidates)] - bias * some.sum(axis=1).astype(out.dtype)[:, None]
        yield slice(at, at + len(some)), out.astype(np.int64)


def best_alike(anchors: pd.DataFrame, candidates: pd.DataFrame, n: int) -> pd.DataFrame:
    """For each anchor its n highest-scoring candidates of the same label and another id; candidates are in the order of ties."""
    found = []
    for label, own in anchors.groupby("label"):
        same = candidates[candidates["label"] == label]
        if not len(same):
            continue
        ids, keys = same["id"].to_numpy(), same["key"].to_numpy()
        for part, scores in products(np.stack(own["x"]), np.stack(same["x"])):
            some = own.iloc[part]
            scores[some["id"].to_numpy()[:, None] == ids] = NO_SCORE
            every = np.arange(len(some))
            for _ in range(min(n, len(ids))):
                best = scores.argmax(axis=1)  # the first of equals
                score = scores[every, best]
                ok = score != NO_SCORE
                found.append(pd.DataFrame({"a_id": some["id"].to_numpy()[ok], "a_key": some["key"].to_numpy()[ok], "id": ids[best[ok]], "key": keys[best[ok]], "score": score[ok]}))
                scores[every, best] = NO_SCORE
    return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a_id", "a_key", "id", "key", "score")})


def best_below(anchors: pd.DataFrame, candidates: pd.DataFrame, n: int, low: int, high: int) -> pd.DataFrame:
    """For each positive of each anchor the n highest-scoring candidates of other labels, from low to high percent of its score."""
    ids, keys, labels = (candidates[c].to_numpy() for c in ("id", "key", "label"))
    most = max(map(len, anchors["scores"]))
    found = []
    for part, scores in products(np.stack(anchors["x"]), np.stack(candidates["x"])):
        some = anchors.iloc[part]
        size = np.array([len(s) for s in some["scores"]])
        least, limit = np.full((2, len(some), most), NO_SCORE)
        for i, s in enumerate(some["scores"]):
            limit[i, : len(s)] = [high * int(x) // 100 for x in s]
            least[i, : len(s)] = [-(-low * int(x) // 100) for x in s]
        lowest = np.where(np.arange(most) < size[:, None], least, np.iinfo(np.int64).max).min(axis=1)
        row, col = np.nonzero((scores >= lowest[:, None]) & (scores <= limit.max(axis=1)[:, None]) & (labels != some["label"].to_numpy()[:, None]))
        score = scores[row, col]
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        first, end = (np.searchsorted(row, np.arange(len(some)), side) for side in ("left", "right"))
        for j in range(most):
            start = first + np.bincount(row[score > limit[row, j]], minlength=len(some))
            for k in range(n):
                at = start + k
                who = np.flatnonzero((j < size) & (at < end))
                who = who[score[at[who]] >= least[who, j]]
                hit = at[who]
                found.append(pd.DataFrame({"a_id": some["id"].to_numpy()[who], "a_key": some["key"].to_numpy()[who], "place": j + 1, "id": ids[col[hit]], "key": keys[col[hit]], "score": score[hit]}))
    return pd.concat(found).astype(np.int64)


def whole_vectors(df: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, x: floor(scale * component)) of the rows that take part, each once."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double"))
    df = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), x.alias("x")).where("id is not null and label is not null and x is not null")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(fine).withColumn("x", F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v))).distinct()


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1 for each anchor and positive.

    ``anchor`` is a condition on the column ``id``. An anchor's positives are the
    first rows of its label with another id, by score and then id; its negatives
    for a positive the first rows of other labels whose score is from low to high
    percent of that positive's. All rows are compared, none is left out by an index.

    Rows with a null id, label, vector or component or one that isn't finite take no part; rows
    that repeat as a whole count once, others that share an id stay apart; shorter
    vectors are as if filled with zeros; ids and labels are whole numbers, components and scores must fit in a long. Anchors without
    positives or negatives give no rows, as does an empty table; other columns are ignored.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, scale, id_col, label_col, vector_col).withColumn("key", F.xxhash64("label", "x"))
    rows = stage_table(rows, "negative-rows")
    n, n_anchors, dims, far = rows.agg(F.count("*"), F.count_if(anchor), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    dims, kind = dims or 0, "int" if (far or 0) < 1 << 31 else "bigint"
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("x")))
    spread = lambda blocks: F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).cast("int")
    rows_of = lambda components: max(1, components // max(1, dims))
    many = max(-(-n // rows_of(CANDIDATES)), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)), 1)
    few = max(-(-n_anchors // rows_of(ANCHORS)), 1)
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.select("id", "label", "key", filled.cast(f"array<{kind}>").alias("x"))
    chosen = rows.where(anchor)
    right = rows.withColumns({"c": spread(many), "a": every(few)}).groupBy("a", "c")
    cut = lambda anchors: anchors.withColumns({"a": spread(few), "c": every(many)}).groupBy("a", "c")

    def alike(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_alike(left, right.sort_values(["id", "key"]), positives) if len(left) and len(right) else pd.DataFrame()

    def below(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_below(left, right.sort_values(["id", "key"]), negatives, low, high) if len(left) and len(right) else pd.DataFrame()

    best = cut(chosen).cogroup(right).applyInPandas(alike, "a_id long, a_key long, id long, key long, score long")
    order = Window.partitionBy("a_id", "a_key").orderBy(F.desc("score"), "id", "key")  # a few rows from each block
    best = stage_table(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    lists = best.groupBy("a_id", "a_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores"))
    with_scores = stage_table(chosen.join(lists.withColumnsRenamed({"a_id": "id", "a_key": "key"}), ["id", "key"]), "scored-anchors")
    found = cut(with_scores).cogroup(right).applyInPandas(below, "a_id long, a_key long, place long, id long, key long, score long")
    order = Window.partitionBy("a_id", "a_key", "place").orderBy(F.desc("score"), "id", "key")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    best = best.select("a_id", "a_key", F.col("place").cast("bigint").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.select("a_id", "a_key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["a_id", "a_key", "place"]).select(F.col("a_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
