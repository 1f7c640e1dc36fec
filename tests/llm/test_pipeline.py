import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from chronopanel.llm import line_dedup, near_dup, quality_rules
from chronopanel.llm.common import stage_table

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [("input", docs)]
    for name, f in P.STAGES:
        docs = stage_table(f(spark, docs, D), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def test_columns_and_filters(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].columns == stages["input"].columns
    kept = quality_rules.apply_rules(stages["input"]).where("kept")
    assert sorted(r.doc_id for r in stages["quality_rules"].collect()) == sorted(r.doc_id for r in kept.collect())
    assert line_dedup.duplicate_lines(stages["line_dedup"]).count() == 0 or stages["line_dedup"].count() == stages["quality_rules"].count()
    classes = near_dup.near_duplicates(stages["line_dedup"])
    assert sorted(r.doc_id for r in stages["near_dup"].collect()) == sorted(r.class_id for r in classes.select("class_id").distinct().collect())


def test_near_stage_keeps_unlike_texts_of_one_id(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(None, "one text alone"), (None, "quite another text"), (None, "a third one"), (None, "a third one"), (7, "under seven"), (7, "also under seven"), (7, "also under seven"), (8, base), (None, base + " more"), (7, base + " other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(P.near_stage(spark, docs, D).collect(), key=str)
    assert kept == sorted(spark.createDataFrame([*rows[:3], rows[4], rows[5], rows[9]], docs.schema).collect(), key=str)
    classes = near_dup.near_duplicates(docs).select("class_h1", "class_h2", "n_in_class").distinct().collect()
    assert sorted(r.n_in_class for r in classes) == [1, 1, 1, 2, 2, 3]


def test_mix_and_packing(stages):
    count = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    total = count(stages["near_dup"])
    assert abs(count(stages["mixing"]) - total) <= 25
    packed = stages["packing"]
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("s"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert sums.where("s != m or s > 4096").count() == 0
    assert packed.where("piece = 0").count() == stages["mixing"].count()


def test_run(spark, stages):
    assert P.run(spark, D).count() == stages["packing"].count()


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_on_odd_rows_and_no_rows(spark, name, stage):
    """Nulls in any column, empty and very long texts, repeated rows and columns of clashing names."""
    text = "\n".join(" ".join(f"word{i * j % 97} of{j}" for j in range(1, 9)) for i in range(1, 12))
    rows = [(1, text, "en", "a", len(text), 1, 2, 3), (1, text, "en", "a", len(text), 1, 2, 3), (None, text + " tail", None, None, None, 4, 5, 6), (2, None, "en", "a", None, None, None, None), (3, "", None, "b", 0, 7, 8, 9)]
    rows += [(4, " ".join(f"w{i}x{i % 7}" for i in range(150_000)), "de", "b", 5, 1, 1, 1), (2**53 + 1, text.replace("of3", "on3"), "en", "c", 1, 2, 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _d long, x0 long, row long")
    out = stage(spark, df, D)
    found = out.collect()
    ids = {r.doc_id for r in found}
    if name == "packing":
        assert {r[0] for r in rows} == ids and len({(r.sequence_id, r.offset) for r in found}) == len(found)
    else:
        assert out.columns == df.columns and ids <= {r[0] for r in rows}
        assert 4 in ids or name not in ("line_dedup", "near_dup")
        own = {(r[5], r[6], r[7]) for r in rows}
        assert all((r["_d"], r["x0"], r["row"]) in own for r in found)
    assert name not in ("line_dedup",) or len(found) == len(rows)
    assert name != "near_dup" or sum(r.doc_id == 1 for r in found) <= 1
    empty = stage(spark, df.where("false"), D)
    assert empty.columns == out.columns and empty.count() == 0
