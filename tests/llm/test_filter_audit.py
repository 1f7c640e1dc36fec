"""The audit of filter orders against a plain replay of every order over every document."""

import random
import re
from itertools import permutations

import pytest

from chronopanel.llm.filter_audit import filter_audit

DOCS = "doc_id long, text string, source string, part string, _h int"
LABELS = "doc_id long, quality int, toxic int, text string"


def replay(docs, labels):
    """{(part, order, step): counts} by removing documents one after the other."""
    good = {i for i, q, _, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t, _ in labels if i is not None and t == 1}
    rows = []
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs) else set()
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                left = [r for r in alive if f not in r[1]]
                hidden = sum(f in r[1] for r in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), hidden, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                alive = left
        total = {f: sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f) for f in "ABCDE"}
        for (p, o, s), v in out.items():
            if p == part:
                v.append(total[o[s - 1]])
    return out


def audited(spark, docs, labels):
    rows = filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_replay(spark, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "DELTA", "é", "a$b", "x\tz", "漢字"] + [f"w{i}" for i in range(80)]
    texts = [None, "", " \n ", "LOUD", "a b " * 5000] + [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(25)]
    docs = [(rnd.choice([None, *range(60)]) if rnd.random() < 0.2 else i, rnd.choice(texts), rnd.choice([None, "", "hot", "hot", "web"]), "clash", i) for i in range(150)]
    labels = [(rnd.choice([None, *range(150)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1]), "clash") for _ in range(120)]
    want = replay(docs, labels)
    assert audited(spark, docs, labels) == want and len(want) == 3 * 600


def test_repeated_rows_and_one_hot_text(spark):
    docs = [(7, "same text", "a", None, None)] * 3 + [(None, "same text", "a", None, None)] * 4 + [(i, "same text", "b", None, None) for i in range(8, 400)]
    labels = [(7, 1, 0, None), (7, 0, 1, None), (9, 1, 1, None)]
    assert audited(spark, docs, labels) == replay(docs, labels)


def test_no_documents(spark):
    assert audited(spark, [], []) == {}
