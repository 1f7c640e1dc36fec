"""The registered queries: against their SQL, or against plain versions where SQL has no form for them."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from chronopanel.llm import media, pii, queries, token_counts

D = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


def rows_of(names, rows):
    return sorted((tuple(f"{r[n]:.9g}" if isinstance(r[n], float) else str(r[n]) for n in sorted(names)) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(D).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    names = want.columns
    assert rows_of(names, [r.asDict() for r in got.collect()]) == rows_of(names, [dict(zip(names, r, strict=True)) for r in want.fetchall()])


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def test_op2_columns(spark):
    texts = documents(spark)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = queries.op2_pii(spark, D).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, texts[r.doc_id]):
                digits = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(f"{k}:") for s in spans) for k in patterns]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in patterns] == (spans or []) and (r.spans or not spans)


def test_op9_columns(spark):
    texts = documents(spark)
    stored = {r.doc_id: bytes(r.media) for r in media.add_media(spark.read.parquet(f"{D}/documents.parquet")).collect()}
    for r in queries.op9_media(spark, D).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        at = 0
        for part in r.feature.split(";"):
            w, h, code = re.fullmatch(r"(\d+)x(\d+):([0-9a-f]{16})", part).groups()
            wide, high = -(-int(w) // 8), -(-int(h) // 8)
            grid = np.frombuffer(payload[at : at + wide * high], np.uint8).reshape(high, wide)
            at += wide * high
            assert code == f"{plain_hash(grid):016x}"
        assert at == len(payload)


def plain_hash(grid):
    """Mean of each cell in 1024ths, rows first, by loops."""
    def cells(values):
        n = len(values)
        if n < 8:
            return [1024 * values[i * n // 8] for i in range(8)]
        edges = [i * n // 8 for i in range(9)]
        return [1024 * sum(values[a:b]) // (b - a) for a, b in zip(edges, edges[1:], strict=False)]

    columns = [cells([int(x) for x in grid[:, j]]) for j in range(grid.shape[1])]
    cells8 = [cells([columns[j][i] for j in range(grid.shape[1])]) for i in range(8)]
    total = sum(map(sum, cells8))
    return int("".join("1" if x * 64 > total else "0" for row in cells8 for x in row), 2)


def test_op6_columns(spark):
    got = queries.op6_quality_model(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents(spark))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_ids_beside_a_null_stay_whole(spark):
    rows = [(2**53 + 1, "mail a@b.cd"), (None, "x"), (2**53 + 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counted = token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for out in (pii.find_pii(df), counted, media.add_media(df), media.read_media(media.add_media(df))):
        assert {r.doc_id for r in out.collect()} == {r[0] for r in rows} and out.schema["doc_id"] == df.schema["doc_id"]
