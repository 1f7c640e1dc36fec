"""Packed products and hard negatives against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, id int, rank string"


def plain(rows, positives=5, negatives=5):
    """The definition by loops over all pairs, of the distinct usable rows."""
    use = set()
    for i, label, x, *_ in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            use.add((i, label, tuple(math.floor(256 * v) for v in x)))
    use = sorted(use)
    out = []
    for a in use:
        if a[0] % 100:
            continue
        score = lambda b: sum(p * q for p, q in zip(a[2], b[2], strict=False))  # noqa: E731, B023
        best = sorted((-score(b), b[0], b) for b in use if b[1] == a[1] and b[0] != a[0])[:positives]
        for s, p, _ in best:
            fit = sorted((-score(b), b[0]) for b in use if b[1] != a[1] and 80 * -s <= 100 * score(b) <= 100 * -s)[:negatives]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0).collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize(("low", "high"), [(-160, 160), (0, 3), (-600, 9), (-(1 << 20), 1 << 20), (-(1 << 26), 1 << 26), (7, 7), (0, 0)])
def test_products_are_exact(low, high):
    rng = np.random.default_rng(1)
    a, c = rng.integers(low, high + 1, (7, 33)), rng.integers(low, high + 1, (45, 33))
    got = np.vstack([s for _, s in H.products(a, c)])
    assert (got.astype(object) == a.astype(object) @ c.astype(object).T).all()


def test_several_candidates_share_a_number():
    wide = H.pack(np.array([[1], [2], [3]]), 5, 10, 3)
    assert wide.tolist() == [[6 + (7 << 10) + (8 << 20)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_loops(spark, seed):
    rnd = random.Random(seed)
    base = [[rnd.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(700):
        x = [v + rnd.choice([0, 0, rnd.uniform(-0.2, 0.2)]) for v in rnd.choice(base)]
        rows.append((i, rnd.choice([0, 0, 1, 2]), x, 5, "clash"))
    rows += [(None, 1, base[0], 1, None), (800, None, base[0], 1, None), (801, 1, None, 1, None), (802, 1, [None] * 8, 1, None), (803, 1, [math.nan] * 8, 1, None), (804, 1, [math.inf] * 8, 1, None), (805, 1, base[0][:3], 1, None), (900, 77, base[1], 1, None)]
    rows += rows[:20]  # whole rows that repeat
    want = plain(rows)
    assert mined(spark, rows) == want and len(want) > 50


def test_a_hot_vector_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "CANDIDATES", 180)
    monkeypatch.setattr(H, "ANCHORS", 9)
    rnd = random.Random(3)
    rows = [(i, i % 3, [0.5, 0.5, 0.25] if i % 3 == 0 or i % 5 == 0 else [rnd.random() for _ in range(3)], 1, "x") for i in range(1200)]
    assert mined(spark, rows) == plain(rows)


def test_large_components(spark):
    rnd = random.Random(4)
    rows = [(i * 20, i % 2, [rnd.uniform(-3e5, 3e5) for _ in range(4)], 1, None) for i in range(80)]
    assert mined(spark, rows) == plain(rows)


def test_nothing_to_compare(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0], 1, None), (2, 1, [1.0], 1, None)]) == []  # no anchor
    assert mined(spark, [(100, 0, [1.0], 1, None), (2, 1, [1.0], 1, None)]) == []  # no positive
    assert mined(spark, [(100, 0, [], 1, None), (101, 0, [], 1, None), (102, 1, [], 1, None)]) == [(100, 101, 1, 102, 0, 0)]
