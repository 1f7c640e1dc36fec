"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot t has the golden-ratio point
frac((t + 1) * phi), which falls into one source's stretch of the cumulative
target shares. A source's slots are ranked, and slot number r of the source
takes its block r: blocks of equal tokens cut the source's shuffled documents,
laid end to end and repeated up to the cap. Once a source has its target, its
further slots stay empty; its last block is cut at the target. So every prefix
of the mix holds each source near its share, and the whole meets the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, running, running_over, stage_table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
PHI = 0.6180339887498949
#: Tokens of a block at most, and into how many slots a mix is cut at least (of one token or more).
BLOCK_WORDS, MIN_SLOTS = 8192, 16384
#: Slots laid out beyond the number of blocks, so that a source that its points reach late still gets its blocks.
SPARE = 64


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, total_share: float = 1.0) -> DataFrame:
    """(source, source_size) -> plus source_id (from 1, by code point), weight and target.

    Sources, in the order of their code points with null last, weigh ``weights``
    in turn. A target stops at ``cap`` times the source's size and the excess is
    shared again by weight: the sources stop in the order of size / weight, so
    one running sum in that order finds all that stop.
    """
    name = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    df = running_over(sizes, name, {"_nth": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    df = df.withColumns({"weight": weight, "_cap": (F.col("source_size") * cap).cast("double")})
    whole = df.agg((F.sum("source_size") * F.lit(total_share)).alias("_total"), F.sum("weight").alias("_weights"))
    df = running_over(df, [F.col("_cap") / F.col("weight"), *name], {"_caps": F.col("_cap"), "_used": F.col("weight")}).crossJoin(whole)  # one row
    left = (F.col("_total") - (F.col("_caps") - F.col("_cap"))) / (F.col("_weights") - (F.col("_used") - F.col("weight")))
    df = df.withColumn("_level", left).withColumn("_stops", F.col("_level") * F.col("weight") >= F.col("_cap"))
    level = df.agg(F.max(F.when(~F.col("_stops"), F.col("_level"))).alias("_open"))  # that of the first which does not stop
    df = df.crossJoin(level).withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("_open") * F.col("weight")))
    return df.select(*sizes.columns, F.col("_nth").alias("source_id"), "weight", "target")


def schedule(plan: DataFrame, slots: int, buckets: int = 256) -> DataFrame:
    """(source_id, lo, hi) of cumulative shares -> (source_id, slot, rank): ranked slots of each source.

    Points are dealt to the sources by a join on the cells of a grid over [0, 1),
    so that neither side is crossed with the other.
    """
    spark = plan.sparkSession
    cells = max(1, min(slots, 4096))
    points = spark.range(slots).withColumn("_u", F.pmod((F.col("id") + 1) * F.lit(PHI), F.lit(1.0)))
    points = points.withColumn("_cell", F.floor(F.col("_u") * cells).cast("int"))
    spans = plan.where("hi > lo").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int"))))
    dealt = points.join(spans, "_cell").where("_u >= lo and _u < hi").select("source_id", F.col("id").alias("slot"))
    step = F.lit(max(1.0, slots / buckets))
    dealt = dealt.withColumn("_order", F.floor(F.col("slot") / step * F.lit((1 << 62) // (buckets + 1))).cast("long"))
    return running(dealt, ["source_id"], "_order", ["slot"], F.lit(1), "rank", buckets + 1).drop("_order")


def row_key(docs: DataFrame) -> Column:
    """128 bits over all columns: rows that are equal in all of them share one."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.concat(F.hex(F.xxhash64(*columns, *[c.isNull() for c in columns])), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), *columns, *[c.isNull() for c in columns])))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, buckets: int = 64) -> DataFrame:
    """docs (doc_id, text, source, any others) -> doc_id, size, source_id, source, source_size, target, taken, first_slot, places, row_key.

    ``taken`` counts the words of the document in the mix, repeats included: the
    overlap of the source's scheduled blocks with the document's stretches of the source's
    line, of which a copy follows for each epoch up to the cap. ``places`` has
    (slot, words) of each copy: the slot of the block that it begins in and the
    words of it that the blocks take. ``first_slot`` is the least of those slots.
    A block has ``block_words`` words, or fewer if the mix would have less than ``MIN_SLOTS`` slots.
    A block that no slot reached, of a source far smaller than a slot's share, comes after all slots.

    Null and blank texts have size 0 and are never taken; their source counts
    with size 0. Rows that repeat are separate documents. The order within a
    source is a hash of id, text and seed, so reruns agree. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", "source", F.regexp_count(text, F.lit(NOT_SPACE)).cast("long").alias("size"), F.md5(text).alias("_text"), row_key(docs).alias("row_key"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text", F.lit(str(seed)))
    sized = sized.withColumn("_h", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") * 4)
    sized = stage_table(sized, "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    plan = stage_table(plan.withColumn("words", F.floor(F.col("target") + 1e-6).cast("long")), "mix-plan")
    whole = plan.agg(F.sum("words").alias("n"), F.sum("target").alias("all")).first()  # one row
    total, block = whole["n"] or 0, max(1, min(block_words, (whole["n"] or 0) // MIN_SLOTS))
    plan = running_over(plan, [F.col("source_id")], {"_to": F.col("target")})
    share = lambda x: x / F.lit(whole["all"]) if total else F.lit(0.0)
    plan = plan.withColumns({"lo": share(F.col("_to") - F.col("target")), "hi": share(F.col("_to")), "blocks": F.ceil(F.col("words") / F.lit(float(block))).cast("long")})
    plan = stage_table(plan.drop("_to", "weight"), "mix-shares")
    slots = -(-total // block) + SPARE
    dealt = schedule(plan.select("source_id", "lo", "hi"), slots)
    ranks = plan.where("blocks > 0").select("source_id", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("rank"))
    placed = ranks.join(dealt, ["source_id", "rank"], "left").withColumn("slot", F.coalesce("slot", F.lit(slots) + F.col("rank")))
    blocks = placed.select("source_id", "rank", "slot", (F.col("rank") * block).alias("b_from"), F.least((F.col("rank") + 1) * block, "words").alias("b_to"))
    laid = sized.join(plan.select(F.col("source").alias("_s"), "source_id", "source_size", "target", "words"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    laid = running(laid, ["source_id"], "_h", ["doc_id", "_text", "row_key"], F.col("size"), "_at", buckets)
    laid = stage_table(laid.withColumn("_row", F.monotonically_increasing_id()), "mix-laid")
    copy = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    runs = laid.where("size > 0").withColumn("copy", copy).withColumn("d_from", F.col("_at") + F.col("copy") * F.col("source_size")).where("d_from < words")
    runs = runs.withColumn("d_to", F.least(F.col("d_from") + F.col("size"), F.col("words")))
    nth = lambda at: F.floor(at / F.lit(block)).cast("long")
    runs = runs.withColumn("rank", F.explode(F.sequence(nth(F.col("d_from")), nth(F.col("d_to") - 1))))
    hits = runs.select("_row", "copy", "source_id", "rank", "d_from", "d_to").join(blocks, ["source_id", "rank"])
    each = hits.groupBy("_row", "copy").agg(F.min_by("slot", "rank").alias("slot"), F.sum(F.least("d_to", "b_to") - F.greatest("d_from", "b_from")).alias("words"))
    taken = each.groupBy("_row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("places"))  # at most ``cap``
    out = laid.join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_id", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot", "places", "row_key")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus in the order of its slots: a row for each place of a document, cut to its first words where the mix takes no more.

    Rows of ``docs`` are matched by all their columns. Rows equal in all of them
    pool their places. A document without places goes. n_chars, where there is one, follows.
    """
    uses = mixed.where("taken > 0").select("row_key", "size", F.explode("places").alias("place")).groupBy("row_key", "size").agg(F.collect_list("place").alias("places"))
    rows = docs.select(row_key(docs).alias("key"), F.struct("*").alias("row")).dropDuplicates(["key"])
    out = rows.join(uses, rows["key"] == uses["row_key"]).select("row", "size", F.explode("places").alias("place"))
    text = F.col("row.text")
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each word with the white space behind it
    lead = text.rlike(r"\A[\x20\x09-\x0D]").cast("int")
    cut = F.array_join(F.slice(pieces, F.lit(1), (F.col("place.words") + lead).cast("int")), "")
    out = out.withColumn("new", F.when(F.col("place.words") < F.col("size"), cut).otherwise(text))
    values = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    out = out.repartitionByRange("place.slot").sortWithinPartitions("place.slot")
    return out.select(*[values[c].alias(c) if c in values else F.col(f"row.`{c}`") for c in docs.columns])
