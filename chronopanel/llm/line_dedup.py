"""Line deduplication by a deletion-neighbourhood join, in DataFrame expressions alone.

A line is dropped if an earlier line, in the order of doc_id and place, is equal
or within ``max_edits`` (0 or 1) insertions, deletions or substitutions of it.
Lines without a word stay.

Every pair within one edit shares a variant: the text left when the edited place
is deleted from both, or from the longer one alone. Emitting one variant for
each character of each line would be a hundredfold of the corpus, so places are
narrowed first, losing nothing: if a line is cut into segments, one edit falls
into one segment and all the rest is equal, so a line that shares no rest with
another line has no partner, and one that does needs variants only of that
segment. Variants that meet are reduced to their earliest line before anything
is joined, so that no group is ever paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, unused

COARSE, FINE = 2, 16


def _rest(line: Column, size: Column, g: Column, segments: int) -> Column:
    """Hash of all of a line but segment g of ``size`` characters' segments, its end counted from the line's end."""
    a, b = _edge(size, g, segments), _edge(size, g + 1, segments)
    return F.xxhash64(size, g, F.substr(line, F.lit(1), a), F.right(line, size - b))


def _edge(size: Column, g: Column, segments: int) -> Column:
    return F.floor(size * g / F.lit(segments)).cast("int")


def _rests(line: Column, length: Column, segments: int) -> Column:
    """(size, g, key) of a line as itself and as one that is a character longer than its partner."""
    sizes = F.array(length, length - 1)
    return F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda g: F.struct(s.alias("size"), g.alias("g"), _rest(line, s, g, segments).alias("key")))))


def _id(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, place and text of every line that has a word."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return each.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _crowded(keys: DataFrame) -> DataFrame:
    """Keys that more than one distinct line has."""
    return keys.groupBy("key").agg(F.min("line_id").alias("_p"), F.max("line_id").alias("_q")).where("_p != _q").select("key")


def duplicate_lines(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """(doc_id, text_key, place) of each line to drop and (kept_doc, kept_place) of the earliest line it repeats.

    Rows equal in doc_id and text are one document. Null doc_ids come last. Null
    texts are empty; lines without a word are no lines here; ties of doc_id go by a hash of the text.
    Other columns are ignored, and no rows give no rows.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("text_key").alias("k"), F.col("place").alias("p"))
    lines = _lines(docs)
    length = F.length("line")
    keys = F.transform(_rests(F.col("line"), length, COARSE), lambda x: x["key"])
    lines = lines.select("doc_id", "text_key", "place", _id(F.col("line")).alias("line_id"), order.alias("at"), (keys if max_edits else F.array().cast("array<bigint>")).alias("keys"))
    lines = stage_table(lines, "lines")
    distinct = stage_table(lines.groupBy("line_id").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")), "distinct-lines")
    best = distinct.where("n > 1").select("line_id", F.col("first").alias("source"))
    if max_edits:
        partner = stage_table(earlier_partners(docs, distinct), "partners")
        best = distinct.join(partner, "line_id", "left").where("n > 1 or partner is not null").select("line_id", F.least("first", "partner").alias("source"))
    best = stage_table(best, "sources")  # of lines that repeat or have a partner; a plain scan, so that a frequent line's side of the join can be split
    found = lines.join(best, "line_id").where(F.col("source") < F.col("at"))
    return found.select("doc_id", "text_key", "place", F.col("source.d").alias("kept_doc"), F.col("source.p").alias("kept_place"))


def earlier_partners(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """distinct (line_id, first, keys) -> (line_id, partner): the earliest line one edit away, if earlier than ``first``."""
    # half of the id will do here: this only proposes lines, and these are the largest shuffles
    each = distinct.select(F.col("line_id.a").alias("line_id"), F.explode("keys").alias("key"))
    likely = each.join(_crowded(each), "key").select(F.col("line_id").alias("_a")).distinct()
    likely = distinct.join(likely, F.col("line_id.a") == F.col("_a"), "left_semi").select("line_id", "first")
    # texts of these lines, from the document that has each first
    wanted = likely.groupBy(F.col("first.d").alias("_d"), F.col("first.k").alias("_k")).agg(F.collect_list(F.struct(F.col("first.p").alias("p"), "line_id", "first")).alias("_want"))
    text = F.coalesce("text", F.lit(""))
    bodies = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_d"), F.xxhash64(text).alias("_k"), text.alias("_text"))
    bodies = bodies.join(wanted, ["_d", "_k"]).dropDuplicates(["_d", "_k"])
    bodies = bodies.select(F.split("_text", "\n").alias("_lines"), F.explode("_want").alias("w"))
    lines = stage_table(bodies.select("w.line_id", "w.first", F.get("_lines", F.col("w.p")).alias("line")), "likely-lines")
    fine = lines.select("line_id", F.explode(_rests(F.col("line"), F.length("line"), FINE)).alias("r")).select("line_id", "r.*")
    fine = stage_table(fine, "line-rests")
    fine = fine.join(_crowded(fine), "key").groupBy("line_id").agg(F.collect_set(F.struct("size", "g")).alias("segments"))
    narrowed = lines.join(fine, "line_id")
    places = F.array_distinct(F.flatten(F.transform("segments", lambda s: F.sequence(_edge(s["size"], s["g"], FINE), _edge(s["size"], s["g"] + 1, FINE)))))
    places = F.filter(places, lambda p: p < F.length("line"))
    without = lambda p: F.concat(F.substr(F.col("line"), F.lit(1), p), F.substr(F.col("line"), p + 2))
    variants = F.array_append(F.transform(places, lambda p: F.struct(p.alias("p"), F.xxhash64(without(p)).alias("v"))), F.struct(F.lit(-1).alias("p"), F.xxhash64("line").alias("v")))
    rows = stage_table(narrowed.select("line_id", "first", F.explode(variants).alias("x")).select("line_id", "first", "x.v", "x.p"), "line-variants")
    # lines with the same variant at the same place differ in that character; a line that is a variant lacks it
    by_place = rows.groupBy("v", "p").agg(F.min("first").alias("m"), F.count("*").alias("n"))
    by_variant = by_place.groupBy("v").agg(F.min(F.when(F.col("p") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("p") >= 0, F.col("m"))).alias("cut"), F.sum("n").alias("n_v"))
    met = by_place.join(by_variant.where("n_v > 1"), "v").select("v", "p", F.when(F.col("p") < 0, F.col("cut")).otherwise(F.least("m", "whole")).alias("partner"))
    found = rows.join(met.where("partner is not null"), ["v", "p"]).where(F.col("partner") < F.col("first"))
    found = found.groupBy("line_id").agg(F.min("partner").alias("partner"))
    # the edit distance itself confirms what equal hashes of variants propose
    named = lines.select(F.col("first").alias("partner"), F.col("line").alias("_other"))
    checked = found.join(lines.select("line_id", "line"), "line_id").join(named, "partner")
    return checked.where(F.levenshtein("line", "_other", 1) >= 0).select("line_id", "partner")


def drop_lines(docs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Documents without their duplicate lines; n_chars, where there is one, follows. No row goes, even if no line is left.

    Null texts stay null; all other columns are kept as they are, whatever their names.
    """
    d, k, gone_, new = unused(docs.columns, "d", "k", "gone", "new")
    gone = duplicates.groupBy(F.coalesce("doc_id", F.lit(2**63 - 1)).alias(d), F.col("text_key").alias(k)).agg(F.collect_set("place").alias(gone_))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), k: F.xxhash64(text)})
    out = keyed.join(gone, [d, k], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone_, i)), "\n")
    out = out.withColumn(new, F.when(F.col(gone_).isNull(), F.col("text")).otherwise(kept))
    values = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col(gone_).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(values).select(*[f"`{c}`" for c in docs.columns])


def line_report(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """One row for each document: doc_id, n_lines (with a word), n_dropped, dropped (places, in order).

    Null and empty texts have no lines; rows equal in doc_id and text get equal rows.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_k"), n.cast("long").alias("n_lines"))
    gone = duplicate_lines(docs, max_edits).groupBy(F.col("doc_id").alias("_d"), F.col("text_key")).agg(F.sort_array(F.collect_set("place")).alias("_gone"))
    out = base.join(gone, base["doc_id"].eqNullSafe(gone["_d"]) & (base["_k"] == gone["text_key"]), "left")
    return out.select("doc_id", "n_lines", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"), F.coalesce(F.array_join("_gone", ","), F.lit("")).alias("dropped"))
