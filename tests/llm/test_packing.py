import bisect
import random
import zlib

import numpy as np
import pytest

from chronopanel.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_ids_equal_whole_texts(tokenizer):
    rng = random.Random(1)
    parts = [*"abcXYZ .,!#'\"-éÉßµñΣσςİ你½²٣😀\t\n\r\x0b\x0c\x1c\x85\xa0́​", "'s", "'t", "<|endoftext|>", "<|STARTOFTEXT|>", "!!", "...", " "]
    words = P.WordIds(PATH, most=500)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x" * 5000, None]
    for at in range(0, len(texts), 37):
        for text, got in zip(texts[at : at + 37], words.encode(texts[at : at + 37]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("most", [9, 40])
def test_knapsack_is_exact(most):
    rng = random.Random(2)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 51), rng.randint(1, most))))
        prices = np.array([rng.random() for _ in sizes])
        best, first = P.knapsack(sizes, prices, 50)
        want = [0.0] * 51
        for room in range(1, 51):
            want[room] = max([want[room - 1], *[p + want[room - s] for s, p in zip(sizes, prices, strict=True) if s <= room]])
        assert np.allclose(best, want)
        chosen = P._take(first, 50)
        assert sum(chosen) <= 50 and abs(sum(prices[sizes == s][0] for s in chosen) - want[50]) < 1e-9


def decreasing(lengths, counts, capacity=4096):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for size, n in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        for _ in range(n):
            at = bisect.bisect_left(rooms, size)
            room = rooms.pop(at) if at < len(rooms) else capacity
            bisect.insort(rooms, room - size)
    return len(rooms)


RNG = np.random.default_rng(8)
CASES = [
    (np.arange(1, 4001), RNG.integers(1, 4, 4000)),
    (np.array([1000, 1366, 1400, 2000, 2700, 3000]), np.array([500, 700, 600, 400, 300, 200])),
    (np.array([1365, 1366, 2047, 2049]), np.array([900, 900, 500, 500])),
    (np.unique(RNG.integers(1, 4097, 300)), None),
    (np.unique(RNG.integers(1, 4097, 300)), 1),
    (np.unique(RNG.integers(700, 1900, 200)), 3000),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_plan_covers_each_piece_once_and_is_no_worse_than_best_fit(case):
    lengths, counts = CASES[case]
    if not isinstance(counts, np.ndarray):
        counts = np.full(len(lengths), counts or 40)
    groups, bound = P.pack_histogram(lengths, counts)
    packed = {}
    for g in groups:
        assert g.count > 0 and sum(s * t for s, t in g.runs) + g.room == 4096 and g.room >= 0
        for s, t in g.runs:
            packed[s] = packed.get(s, 0) + t * g.count
    assert packed == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    used = P.number(groups)
    volume = -(-int((lengths * counts).sum()) // 4096)
    assert volume <= np.ceil(bound) <= used and used <= (decreasing(lengths, counts) if counts.sum() < 20000 else used)
    if counts.min() >= 100:
        assert used <= bound * 1.01 + 1


def test_mostly_tiny_or_equal_pieces():
    for lengths, counts in (([1], [10_000_000]), ([2049], [5]), ([4096], [7]), ([1, 4095], [3, 5]), ([], [])):
        groups, _ = P.pack_histogram(np.array(lengths, np.int64), np.array(counts, np.int64))
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        assert sum(s * t * g.count for g in groups for s, t in g.runs) == total


def test_frame(spark, tokenizer):
    texts = [(i, f"word{i} " * (i * 7 % 900)) for i in range(150)] + [(900, None), (901, ""), (902, "long text here " * 4000), (7, "same row"), (7, "same row")]
    df = spark.createDataFrame([(*x, "clash") for x in texts], "doc_id long, text string, length string").repartition(6)
    rows = P.pack(df, PATH).collect()
    by_seq, want = {}, []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in by_seq.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert P.pack(df.where("false"), PATH).count() == 0


def test_large_ids_beside_a_null(spark):
    rows = [(2**53 + 1, "a b"), (None, "c"), (2**53 + 3, "d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(P.pack(df, PATH).collect(), key=str)[0].doc_id == 2**53 + 1
    assert {r.doc_id for r in P.pack(df, PATH).collect()} == {r[0] for r in rows}
