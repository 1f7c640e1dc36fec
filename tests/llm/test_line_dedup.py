import random

import pytest

from chronopanel.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_chars long, place string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, max_edits):
    seen, gone = [], set()
    lines = [(d, k, line) for d, text in sorted(docs) for k, line in enumerate((text or "").split("\n")) if line.strip(" \t\n\x0b\x0c\r")]
    for d, k, line in lines:
        for other in seen:
            near = max_edits and abs(len(line) - len(other)) <= 1 and distance(line, other) <= max_edits
            if line == other or near:
                gone.add((d, k))
                break
        seen.append(line)
    return gone


@pytest.mark.parametrize("seed,max_edits", [(1, 1), (2, 1), (4, 1), (3, 0)])
def test_equals_brute_force(spark, seed, max_edits):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcé 你") for _ in range(rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 20, 41]))) for _ in range(8)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                p = rng.randrange(len(line) + 1)
                kind = rng.random()
                if kind < 0.4 and line:
                    line[p % len(line)] = rng.choice("abz")
                elif kind < 0.7:
                    line.insert(p, rng.choice("abz"))
                elif line:
                    del line[p % len(line)]
            lines.append("".join(line))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame([(*r, len(r[1]), "clash") for r in docs], SCHEMA).repartition(5)
    got = {(r.doc_id, r.place) for r in L.duplicate_lines(df, max_edits).collect()}
    assert got == brute(docs, max_edits)


def test_drop_and_report(spark):
    rows = [(2, "one long enough line\nkeep me here please\n\nOne long enough line"), (1, "one long enough line"), (3, None), (4, ""), (5, "keep me here pleas"), (5, "keep me here pleas")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    out = {r.doc_id: r for r in L.drop_lines(df, L.duplicate_lines(df)).collect()}
    assert out[1].text == "one long enough line" and out[1].n_chars == 1
    assert out[2].text == "keep me here please\n" and out[2].n_chars == 20 and out[2].place == "clash"
    assert out[3].text is None and out[4].text == "" and out[5].text == ""
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.dropped) for r in L.line_report(df).collect()) == [(1, 1, 0, ""), (2, 3, 2, "0,3"), (3, 0, 0, ""), (4, 0, 0, ""), (5, 1, 1, "0"), (5, 1, 1, "0")]
    assert L.drop_lines(df.where("false"), L.duplicate_lines(df.where("false"))).count() == 0


def test_clashing_names_null_ids_and_long_texts(spark):
    long = "\n".join(f"line number {i} of a long text" * 3 for i in range(0, 60000, 20))
    rows = [(None, "first line here", 1, 2, 3, 4), (7, "first line here", 1, 2, 3, 4), (8, long, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d long, _k long, _gone long, _new long")
    out = L.drop_lines(df, L.duplicate_lines(df))
    assert out.columns == df.columns and sorted(out.collect(), key=str) == sorted(spark.createDataFrame([(None, "", 1, 2, 3, 4), *rows[1:]], df.schema).collect(), key=str)


def test_no_python_in_any_plan(spark, monkeypatch):
    plans, stage = [], L.stage_table
    monkeypatch.setattr(L, "stage_table", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stage(df, name))
    plans.append(L.line_report(spark.createDataFrame([(1, "a line of some length", 1, "")], SCHEMA))._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))
