"""Filter interaction audit: what every order of a few filters removes, and what it hides from the next ones.

A document becomes a mask of the filters that it fails, and documents become
counts by part and mask. Each such cell folds over the array of all orders
(``aggregate`` walks one order, ``transform`` all of them), which gives one
weighted struct for each order and step; structs of a part are summed element by
element. Documents are never collected: a part has at most 2**filters cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that filter D looks for.
SYMBOLS = "[#$%&*|]"
#: What a step counts, in the order of the result's columns.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Hash ranges over which rows without an id are spread.
SPOTS = 4096


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of one text, of which null is the empty one: too short, repetitive, shouting, with symbols."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def _bits(conditions: list[Column]) -> Column:
    mask = F.lit(0)
    for i, failed in enumerate(conditions):
        mask = mask + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of the mask, and the labelled ones of them.

    Bit i of the mask stands for the i-th of ``failures``, the bit above them for a
    text that some smaller id of the whole table has too. Texts meet as digests,
    first counted by text, part and label, so a text that a third of all rows share
    is a few rows by then. A null id is neither smaller nor larger than another and
    has no label; an id that repeats with the same text isn't its own duplicate; of
    an id's several labels any that is 1 counts; a null part is the empty string.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_h"), _bits(list(failures.values())).alias("_own"))
    rows = rows.withColumn("_spot", F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("_h"), F.lit(SPOTS))).otherwise(F.lit(0)))
    marks = labels.select(labels[id_col].alias("_l"), (labels["quality"] == 1).alias("_good"), (labels["toxic"] == 1).alias("_toxic")).where("_l is not null and (_good or _toxic)")
    marks = marks.groupBy("_l").agg(F.max(F.coalesce("_good", F.lit(False))).alias("_good"), F.max(F.coalesce("_toxic", F.lit(False))).alias("_toxic")).withColumn("_zero", F.lit(0).cast("bigint"))
    rows = rows.join(marks, (rows["_id"] == marks["_l"]) & (rows["_spot"] == marks["_zero"]), "left").fillna(False, ["_good", "_toxic"])
    kinds = ["_h", "_own", "part", "_good", "_toxic"]
    same = rows.groupBy("_id", "_spot", *kinds).agg(F.count("*").alias("_n"))
    texts = same.groupBy(*kinds).agg(F.sum("_n").alias("_n"), F.min("_id").alias("_first"), F.min_by("_n", "_id").alias("_at_first"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_unnamed"))
    own_first = F.col("_first") == F.min("_first").over(Window.partitionBy("_h"))
    texts = texts.withColumn("_new", F.col("_unnamed") + F.when(own_first, F.col("_at_first")).otherwise(F.lit(0)))
    twice = 1 << len(failures)
    cells = texts.select("part", "_good", "_toxic", F.explode(F.array(F.struct(F.col("_own").alias("mask"), F.col("_new").alias("n")), F.struct((F.col("_own") + twice).alias("mask"), (F.col("_n") - F.col("_new")).alias("n")))).alias("_c"))
    cells = cells.select("part", "_good", "_toxic", "_c.*").where("n > 0")
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c[1:])
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), only("_good"), only("_toxic"))


def fold_orders(mask: Column, n: Column, good: Column, toxic: Column, orders: list[tuple[int, ...]]) -> Column:
    """Array of a struct of COUNTS for each order and step: what the cell's documents add there."""
    weights = {"kept": n, "removed": n, "redundant": n, "unique_fails": n, "good_lost": good, "toxic_lost": toxic}
    empty = F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>")
    every = F.array(*[F.array(*map(F.lit, o)) for o in orders])  # goes to each task with the plan

    def step(state: Column, bit: Column) -> Column:
        alive, fails = state["alive"], F.getbit(mask, bit) == 1
        here = alive & fails
        holds = {"kept": alive & ~fails, "removed": here, "redundant": ~alive & fails, "unique_fails": fails & (F.bit_count(mask) == 1), "good_lost": here, "toxic_lost": here}
        counts = F.struct(*[F.when(holds[c], weights[c]).otherwise(F.lit(0)).cast("bigint").alias(c) for c in COUNTS])
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["counts"], F.array(counts)).alias("counts"))

    start = F.struct(F.lit(True).alias("alive"), empty.alias("counts"))
    return F.flatten(F.transform(every, lambda order: F.aggregate(order, start, step, lambda s: s["counts"])))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the letters and step, zeros included; no cells give no rows.

    kept and removed count documents after and at the step, redundant those that fail its
    filter but went earlier, unique_fails those that fail no other, good_lost and
    toxic_lost the labelled ones removed here; shapley sums the filter's removed
    over all orders.
    """
    orders = list(permutations(range(len(letters))))
    steps = cells.select("part", F.posexplode(fold_orders(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"), orders)).alias("_at", "_s"))
    sums = steps.groupBy("part", "_at").agg(*[F.sum(f"_s.{c}").alias(c) for c in COUNTS])
    names = F.array(*[F.lit("".join(letters[i] for i in o)) for o in orders])
    place = F.col("_at") % len(letters)
    rows = sums.select("part", F.get(names, F.floor(F.col("_at") / len(letters)).cast("int")).alias("filter_order"), (place + 1).cast("int").alias("step"), *COUNTS)
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # as many rows as orders
    return rows.withColumn("shapley", F.sum("removed").over(own))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the four text filters and the duplicate filter, A to E, over whole texts.

    Null texts are empty (they fail A, and E after the first); an empty table gives
    no rows; columns other than the three named and the labels' are ignored.
    """
    failures = text_failures(docs[text_col])
    return audit(mask_cells(docs, labels, failures, id_col, text_col, part_col), "".join(failures) + "E")
