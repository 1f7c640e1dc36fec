"""From raw documents to packed training sequences: quality rules, dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronopanel.llm import line_dedup, mixing, near_dup, packing, quality_rules
from chronopanel.llm.common import stage_table
from chronopanel.llm.queries import table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line of the corpus equals or is one edit from."""
    return line_dedup.drop_lines(docs, line_dedup.duplicate_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least doc_id, then the least hashes; rows that repeat become one."""
    return near_dup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and for the last time as far, as the mix takes them, in the order of the mix."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: Signatures, the linear program and the tokenizer have no SQL form; tests/llm holds each stage's operator against brute
#: force on its own, and the stages on tables with nulls, empty and long texts, repeats and clashing names.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread.

    Null and empty texts fail the base rules and end there; null ids, languages and sources are kept as such;
    documents that lose all lines stay as empty ones until near_dup makes one of them, which the mix never takes. Rows
    that repeat become one in near_dup. An empty table gives no rows and the columns of the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
