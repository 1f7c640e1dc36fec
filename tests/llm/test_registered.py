"""Registered queries without SQL, on the given tables, against plain versions of their contracts."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronopanel.llm import packing, queries

D = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_op4_packs_each_piece_once(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.add((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    rows = queries.op4_packing(spark, D).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    lengths, counts = np.unique([r.length for r in rows], return_counts=True)
    assert len(sequences) <= packing.number(packing.best_fit(lengths, counts, [], 4096)) and len(sequences) >= -(-sum(r.length for r in rows) // 4096)


def test_op7_allocates_each_token_to_the_line_with_most_of_it(spark, texts):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.op7_token_counts(spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        owner = [i for i, line in enumerate(text.split("\n")) for _ in (line + "\n").encode()][: len(text.encode())]  # each byte's line
        counts, at, crossing = Counter(), 0, 0
        tokens = encoding.encode_ordinary(text)
        for token in tokens:
            held = Counter(owner[at : at + len(encoding.decode_single_token_bytes(token))])
            at += len(encoding.decode_single_token_bytes(token))
            counts[min(held, key=lambda i: (-held[i], i))] += 1
            crossing += len(held) > 1
        n = text.count("\n") + 1
        assert (r.n_tokens, r.n_crossing, r.n_sections, r.section_tokens) == (len(tokens), crossing, n, ",".join(str(counts[i]) for i in range(n)))


def test_op8_base_columns_and_verdicts(spark, texts):
    rows = queries.op8_quality_rules(spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        w, lines = words(texts[r.doc_id]), [x for x in texts[r.doc_id].split("\n") if words(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        repeated = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)
    judged = [r for r in rows if not r.base_failed]
    kept, gone = [r.distance for r in judged if r.kept], [r.distance for r in judged if not r.kept]
    assert len(kept) > 0.8 * len(judged) and min(gone, default=1e9) > max(kept) * 0.99  # one cut


def test_op10_joins_all_near_pairs_and_no_others(spark, texts):
    rows = {r.doc_id: r for r in queries.op10_near_dup(spark, D).collect()}
    assert sorted(rows) == sorted(texts)
    bags = {}
    for doc, text in texts.items():
        w = words(text)
        bags[doc] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    by_shingle = defaultdict(set)
    for doc, bag in bags.items():
        for s in bag:
            by_shingle[s].add(doc)
    near = defaultdict(set)
    for a, b in {p for docs in by_shingle.values() for p in itertools.combinations(sorted(docs), 2)}:
        both = (bags[a] & bags[b]).total()
        if both >= 0.8 * (bags[a].total() + bags[b].total() - both):
            near[a].add(b)
            near[b].add(a)
    pairs = [(a, b) for a in near for b in near[a] if a < b]
    assert sum(rows[a].class_id == rows[b].class_id for a, b in pairs) >= 0.99 * len(pairs) and pairs
    for doc, r in rows.items():  # whoever shares a class has a near neighbour or an equal text
        if r.n_in_class > 1:
            assert near[doc] or sum(t == texts[doc] for t in texts.values()) > 1
