import random

from pyspark.sql import functions as F

from chronopanel.llm import mixing as M


def shares(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    """Share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(full) < len(order):
        open_ = [s for s in order if s not in full]
        each = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in open_:
            target[s] += each * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                full.add(s)
    return target


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, target string").repartition(4)


def check(spark, rows, block_words):
    got = M.mix(make(spark, rows), block_words).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken = shares(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1 + 1e-6 * t
    return got


def test_targets_and_taken(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 300))), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(300)]
    first = check(spark, rows, 64)
    again = M.mix(make(spark, rows[::-1]), 64).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_hot_tiny_and_empty_sources(spark):
    rows = [(i, "w " * 50, "hot") for i in range(100)] + [(200, "one", "tiny"), (201, None, "none"), (202, "  \n", "none"), (203, "a b", None)]
    check(spark, rows, 1000)
    assert M.mix(make(spark, rows).where("false")).count() == 0
    assert {r.taken for r in M.mix(make(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}


def test_slots_follow_the_schedule(spark):
    plan = spark.createDataFrame([(1, 0.0, 0.6), (2, 0.6, 0.9), (3, 0.9, 1.0)], "source_id int, lo double, hi double")
    rows = M.schedule(plan, 1000).collect()
    assert sorted(r.slot for r in rows) == list(range(1000))
    for source, share in ((1, 600), (2, 300), (3, 100)):
        own = sorted((r.slot, r["rank"]) for r in rows if r.source_id == source)
        assert [x[1] for x in own] == list(range(len(own))) and abs(len(own) - share) <= 4


def order(rows):
    """(slot, source, words) of every place in the mix, in order."""
    return sorted((p.slot, r.source, p.words) for r in rows for p in r.places or [])


def test_prefixes_hold_each_share_and_points_decide(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 60))), rng.choice("aaaabbc")) for i in range(2000)]
    got = M.mix(make(spark, rows), 64).collect()
    places, targets = order(got), {r.source: r.target for r in got}
    total, seen, done = sum(targets.values()), dict.fromkeys(targets, 0), 0
    for _, source, words in places:
        seen[source] += words
        done += words
        for s, t in targets.items():  # a copy stands at its first slot with all its words, up to 60 here
            assert abs(seen[s] - done * t / total) <= 4 * 64
    monkeypatch.setattr(M, "PHI", 0.123)
    assert [x[1] for x in order(M.mix(make(spark, rows), 64).collect())] != [x[1] for x in places]


def test_the_mix_comes_in_order_and_rows_of_other_columns_stay_apart(spark):
    rows = [(1, "a b c d", "x", "en", 7), (1, "a b c d", "x", "de", 7), (2, "e f", "y", "en", 7), (None, "g h i", None, None, 7), (None, None, "x", None, None), (3, "", "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key long")
    mixed = M.mix(df)
    out = M.apply_mix(df, mixed).collect()
    assert {r.lang for r in out if r.doc_id == 1} == {"en", "de"} and sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixed.collect())
    assert M.apply_mix(df.where("false"), M.mix(df.where("false"))).columns == df.columns
    many = make(spark, [(i, "w " * 20 + str(i), "ab"[i % 2]) for i in range(400)])
    mixed = M.mix(many)
    slot = {r.doc_id: [p.slot for p in r.places or []] for r in mixed.collect()}
    out = [r.doc_id for r in M.apply_mix(many, mixed).collect()]
    best, last = 0, -1
    for doc in out:  # rows come by slot
        last = min(x for x in slot[doc] if x >= last)
        best += 1
    assert best == sum(map(len, slot.values()))


def test_apply(spark):
    rows = [(i, f"a{i}  b\nc d", s) for i, s in enumerate("xxxxyyz")] + [(3, "a3  b\nc d", "x")]
    df = make(spark, rows)
    mixed = M.mix(df, 5).cache()
    out = M.apply_mix(df, mixed)
    assert out.columns == df.columns
    words = F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    assert out.agg(words).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    whole = {r[1] for r in rows}
    assert all(r.text in whole or any(w.startswith(r.text) for w in whole) for r in out.collect())
