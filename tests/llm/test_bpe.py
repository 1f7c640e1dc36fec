"""Encoding by forced boundaries against the tokenizers library, and back."""

import hashlib
import random

import pytest

from chronopanel.llm import bpe, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def adversarial(n):
    """Texts whose words, white space, apostrophes and special strings stand in every neighbourhood."""
    rnd = random.Random(5)
    parts = [*"abzqXZ 019'.,#-\n\t\r\x0b\x1c\x1d\x85", " ", " ", "​", "　", "᠎", "﻿", "'s", "'re", "'ll", " 't", "<|endoftext|>", "<|", "|>", "é", "ß", "漢字", "😀", "́", "ا", "१", "Ⅷ", "²", "zq", "  ", "\n\n"]
    for _ in range(n):
        yield "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        yield "".join(chr(rnd.choice([rnd.randint(0, 0x7F), rnd.randint(0x80, 0x2FFF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(rnd.randint(0, 12)))


def test_equals_the_library(path, library):
    own = bpe.codec(path)
    for text in adversarial(8000):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_broken_utf8_decodes_as_by_the_library(path, library):
    own, rnd = bpe.codec(path), random.Random(6)
    for _ in range(2000):
        ids = [rnd.randint(0, 50256) for _ in range(20)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_never_inside_a_token(path):
    own = bpe.codec(path)
    for token in own.tokens.values():
        assert not any(own.cuts[(a << 8) | b] for a, b in zip(token, token[1:], strict=False)) or token in {s.encode() for s in own.special}
    assert len(own.fragments("several words, in a row; and more of them")) > 8  # it does cut


def test_rows(spark, path, library):
    long = "word " * 150_000
    rows = [(1, "text", None), (1, "text", "x"), (None, "", "y"), (2**53 + 1, None, "z"), (4, long, None), (5, "x" * 70_000, None), (6, "<|endoftext|>", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    named = df.withColumnRenamed("IDS", "other")
    got = bpe.decode(bpe.encode(named, path), path).collect()
    assert [(r.doc_id, r.text, r.other) for r in got] == rows
    assert [(r.doc_id, r.text, r.other, r.ids, r.decoded) for r in bpe.encode(named, path, decoded="decoded").collect()] == [(r.doc_id, r.text, r.other, r.ids, r.decoded) for r in got]
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(df, path).where("text = 'text'").select("ids").first()[0] == library.encode("text").ids  # a clashing column is replaced
    assert bpe.encode(df.limit(0), path).count() == 0
    odd = spark.createDataFrame([(None,), ([None, 464],), ([10**6],)], "ids array<int>")
    assert sorted(r.decoded for r in bpe.decode(odd, path).collect()) == ["", "", "The"]


def test_op12_columns(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = queries.op12_bpe(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
