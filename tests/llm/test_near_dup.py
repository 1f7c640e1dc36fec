import collections
import random

import numpy as np
import pytest

from chronopanel.llm import near_dup as N


def bag(text):
    w = N.split_words(text)
    if not w:
        return collections.Counter()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def similar(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def classes(docs):
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: bag(t) for i, t in docs}
    for i, t in docs:
        for j, u in docs:
            if i < j and ((t or "") == (u or "") or bags[i] and bags[j] and similar(bags[i], bags[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in docs}


def test_classes_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 20, 90, 200]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
    shared = [word() for _ in range(60)]
    docs += [(1000 + i, " ".join(shared + [word() for _ in range(rng.randint(10, 60))])) for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, " \n"), (2004, "a b a b a b a b a b a b a b a b"), (2005, "a b a b a b a b")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n string").repartition(5)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == classes(docs)


def test_small_data_equals_inverted_index(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    assert {r.doc_id: r.class_id for r in N.near_duplicates(rows).collect()} == classes(docs)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "other text"), (4, "x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.class_id == 2**63 - 1, r.n_in_class) for r in N.near_duplicates(df).collect())
    assert got == [("3", False, 3), ("3", False, 3), ("4", False, 1), ("None", False, 3), ("None", True, 1)]
    assert N.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("pair", [({1: 1, 2: 1, 3: 1}, {1: 1, 2: 1, 4: 1}), ({1: 5, 2: 1}, {1: 2, 2: 3}), ({1: 9}, {1: 3, 5: 2}), ({7: 1}, {7: 1})])
def test_registers_agree_by_weighted_jaccard(pair):
    m = 4096
    hashes = N.mix64(np.array([k for p in pair for k in p], np.uint64))
    weights = np.array([w for p in pair for w in p.values()])
    owner = np.array([i for i, p in enumerate(pair) for _ in p])
    a, b = N.bag_minhash(hashes, weights, owner, 2, m)
    keys = set(pair[0]) | set(pair[1])
    want = sum(min(pair[0].get(k, 0), pair[1].get(k, 0)) for k in keys) / sum(max(pair[0].get(k, 0), pair[1].get(k, 0)) for k in keys)
    assert abs((a == b).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5 + 1e-9


def group(size, seed):
    """Copies of one passage of 60 words, each with 3 to 5 words of its own in place of others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    for i in range(size):
        own = list(base)
        for at in rng.sample(range(60), rng.randint(3, 5)):
            own[at] = f"w{i}x{at}"
        yield i, " ".join(own)


def test_pairs_of_a_large_group_grow_with_it(spark, monkeypatch):
    """Members that are all too far from each other: compared in proportion to their number, not to its square."""
    seen = []
    verify = N.verify
    monkeypatch.setattr(N, "verify", lambda pairs, *a: seen.append(pairs.count()) or verify(pairs, *a))
    took = []
    for size in (800, 1600, 3200):
        seen.clear()
        N.near_duplicates(spark.createDataFrame(list(group(size, 5)), "doc_id long, text string")).count()
        took.append(sum(seen))
    assert took[1] <= 2.3 * took[0] + 50 and took[2] <= 2.3 * took[1] + 50 and took[2] < 5 * 3200


def test_close_pairs_inside_a_large_group_are_found(spark):
    """Far from every leader, but close to each other: only the prefix join can find these."""
    rng = random.Random(3)
    docs = list(group(150, 6))
    for i in range(0, 150, 5):
        words = docs[i][1].split(" ")
        words[0 if rng.random() < 0.5 else -1] = "changed"
        docs.append((1000 + i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes(docs)


def test_prefix_pairs_hold_every_pair_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    sets = []
    for base in range(12):
        own = rng.choice(400, rng.integers(3, 60), replace=False)
        for _ in range(6):
            sets.append(sorted({*rng.choice(own, max(1, len(own) - rng.integers(0, 6)), replace=False).tolist(), *rng.choice(400, rng.integers(0, 5)).tolist()}))
    rows = [((i, i), s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "v struct<h1:long,h2:long>, items array<long>")
    got = {(r.a.h1, r.b.h1) for r in N.prefix_pairs(df.selectExpr("v", "v as label"), df, 0.8).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}
    assert len(want) > 20 and want <= got and len(got) < 3 * len(want) + 50


def test_recall_of_planted_pairs(spark):
    """Pairs at 0.8 or more that brute force over an inverted index finds on a given table: at least 0.99 are in one class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    bags, index = {i: bag(t) for i, t in docs}, collections.defaultdict(list)
    for i, b in bags.items():
        for g in b:
            index[g].append(i)
    pairs = {(a, b) for own in index.values() for a in own for b in own if a < b}
    near = [p for p in pairs if similar(bags[p[0]], bags[p[1]]) >= 0.8]
    got = {r.doc_id: (r.class_h1, r.class_h2) for r in N.near_duplicates(rows).collect()}
    assert len(near) > 50 and sum(got[a] == got[b] for a, b in near) >= 0.99 * len(near)


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(2, text, 1, 2, "c"), (1, text + " more", 3, 4, "d"), (None, None, 5, 6, "e"), (5, "", 7, 8, "f"), (6, "long " * 200_000, 9, 9, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long, h1 long, row string")
    got = sorted(N.keep_one(df).collect(), key=str)
    assert got == sorted(spark.createDataFrame([rows[1], rows[3], rows[4]], df.schema).collect(), key=str)
    assert N.keep_one(df.where("false")).columns == df.columns


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([((i * 7919 % 1000, i), ((i + 1) * 7919 % 1000, i + 1)) for i in range(60)] + [((5000, 1), (5001, 1))], "a struct<h1:long,h2:long>, b struct<h1:long,h2:long>")
    labels = collections.Counter(tuple(r.label) for r in N.components(edges).collect())
    assert sorted(labels.values()) == [2, 61]
