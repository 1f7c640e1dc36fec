import random
import re

from chronopanel.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns as they are stated, and their checks."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s[:3] for s in pii.spans(text) if s[0] in BASE]


def test_equals_the_plain_patterns():
    random.seed(3)
    parts = ["a@b.c", "@", "x.y@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4", "11", " ", "-", ".", "+1 (743) 555-3824", "+", "(", "é", "\n", "ab", "%", "0000000000000", "007.0.0.1"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 14)))
        assert base(text) == plain(text), text


def test_corpus_equals_the_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: plain(r.text or "") for r in docs.collect()}
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE] for r in pii.find_pii(docs).collect()}
    assert got == want


def test_added_kinds_and_scores():
    text = "my iban is DE89 3704 0044 0532 0130 00 ok"
    (found,) = [s for s in pii.spans(text) if s[0] == "iban"]
    assert text[found[1] : found[2]] == "DE89 3704 0044 0532 0130 00" and found[3] == 1.0
    assert not [s for s in pii.spans(text.replace("89", "88")) if s[0] == "iban"]
    assert not pii.spans("part 123-45-6789") and [s[0] for s in pii.spans("ssn 123-45-6789")] == ["national_id"]
    assert pii.redact("call +1 743 555 3824 now", pii.spans("call +1 743 555 3824 now")) == "call <phone> now"
    assert pii.redact(None, []) is None


def test_very_long_runs_are_linear():
    for c in ("a", "1", "a.", "1.", "1 ", "+1", "@", "AB12 ", "1-"):
        assert isinstance(pii.spans(c * 200_000), list)


def test_frame_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a@b.c", "z"), (3, "a@b.c", "z")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id, len(r.spans)) for r in pii.find_pii(df).collect())
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert pii.find_pii(df.where("false")).count() == 0
