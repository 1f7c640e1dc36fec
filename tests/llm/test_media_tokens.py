import io
import random

import numpy as np
import pytest

from chronopanel.llm import media as J
from chronopanel.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
TIK = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_store_is_lossless():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (64, 128, 64 * 9, 64 * 700)] + [bytes(64), b"\xff" * 640, J.pad("é" * 100)]
    got = J.thumbnails(J.store(payloads))
    assert [b"".join(g.tobytes() for _, _, g in x) for x in got] == payloads
    assert got[2][0][:2] == (512, 72)


def test_long_payload_is_several_images():
    payload = np.random.default_rng(2).integers(0, 256, 64 * (J.MAX_ROWS + 3)).astype(np.uint8).tobytes()
    (got,) = J.thumbnails(J.store([payload]))
    assert len(got) == 2 and b"".join(g.tobytes() for _, _, g in got) == payload


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def plain_jpeg(levels, restart, colour):
    """Another encoder: flat tables, AC terms in some blocks, 4:2:0 colour if asked, partial edge blocks."""
    rng = random.Random(3)
    dc = J._dht(0x00, [0] * 3 + [12] + [0] * 12, list(range(12)))
    ac_symbols = [0x00, 0xF0, 0x01, 0x12, 0x23]
    ac = J._dht(0x10, [0] * 2 + [5] + [0] * 13, ac_symbols)
    h, w = levels.shape
    k = 2 if colour else 1
    parts = bytes([1, 0x11 * k, 0]) + (bytes([2, 0x11, 0, 3, 0x11, 0]) if colour else b"")
    head = b"\xff\xd8" + J._DQT + b"\xff\xc0" + len(b"x" * (8 + len(parts))).to_bytes(2, "big") + bytes([8]) + (h * 8 - 3).to_bytes(2, "big") + (w * 8 - 5).to_bytes(2, "big") + bytes([3 if colour else 1]) + parts + dc + ac
    head += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    n = 3 if colour else 1
    head += b"\xff\xda" + (6 + 2 * n).to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0"
    out, bits, last, mcu, mark = [], Bits(), [0] * n, 0, 0
    grid = np.pad(levels, ((0, -h % k), (0, -w % k)), mode="edge").astype(int) - 128
    for y in range(0, grid.shape[0], k):
        for x in range(0, grid.shape[1], k):
            if restart and mcu and mcu % restart == 0:
                out += [bits.data(), bytes([0xFF, 0xD0 + mark % 8])]
                bits, last, mark = Bits(), [0] * n, mark + 1
            blocks = [(0, grid[y + j, x + i]) for j in range(k) for i in range(k)] + [(c, rng.randint(-50, 50)) for c in range(1, n)]
            for c, v in blocks:
                diff = int(v - last[c])
                last[c] = int(v)
                size = abs(diff).bit_length()
                bits.put(size, 4)
                bits.put(diff if diff >= 0 else diff + (1 << size) - 1, size)
                if rng.random() < 0.4:
                    bits.put(1, 3)  # sixteen zeros
                    bits.put(3, 3)  # a zero and a term of two bits
                    bits.put(2, 2)
                    bits.put(2, 3)  # a term of one bit
                    bits.put(1, 1)
                bits.put(0, 3)
            mcu += 1
    return head + b"".join(out) + bits.data() + b"\xff\xd9"


@pytest.mark.parametrize("restart,colour", [(0, False), (3, False), (0, True), (2, True)])
def test_other_baseline_images(restart, colour):
    levels = np.random.default_rng(4).integers(0, 256, (5, 7)).astype(np.uint8)
    ((width, height, grid),) = J.thumbnails([plain_jpeg(levels, restart, colour)])[0]
    assert (width, height) == (51, 37) and (grid == levels).all()


def test_against_another_decoder():
    image = pytest.importorskip("PIL.Image")
    payload = bytes(range(256)) * 2
    (data,) = J.store([payload])
    pixels = np.asarray(image.open(io.BytesIO(data)))
    assert pixels[::8, ::8].tobytes() == payload


def test_bad_images_raise():
    with pytest.raises(ValueError):
        list(J.parse(b"no image"))
    with pytest.raises(ValueError):
        list(J.parse(J.store([bytes(64)])[0].replace(b"\xff\xc0", b"\xff\xc2")))


def test_media_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "é" * 70_000, "z"), (4, "same", "z"), (4, "same", "z")], "doc_id long, text string, media string")
    rows = J.read_media(J.add_media(df)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and (got[1].n_bytes, got[1].payload_bytes) == (0, 64) and got[1].media_sha256 == got[2].media_sha256
    assert got[3].payload_bytes == 140_032 and got[3].feature.startswith("512x")
    assert J.read_media(J.add_media(df.where("false"))).count() == 0


def brute(ends, bounds, rule):
    out, cross, start = [0.0] * len(bounds), 0, 0
    for end in ends:
        share, a = [0] * len(bounds), 0
        for i, b in enumerate(bounds):
            share[i] = max(0, min(end, b) - max(start, a))
            a = b
        inside = [i for i, s in enumerate(share) if s]
        cross += len(inside) > 1
        if rule == "start":
            out[inside[0]] += 1
        elif rule == "majority":
            out[share.index(max(share))] += 1
        else:
            for i in inside:
                out[i] += share[i] / (end - start)
        start = end
    return out, cross


@pytest.mark.parametrize("rule", T.RULES)
def test_allocation_equals_brute_force(rule):
    rng = random.Random(5)
    for _ in range(300):
        total = rng.randint(1, 40)
        ends = sorted({*rng.sample(range(1, total + 1), rng.randint(0, total - 1)), total})
        bounds = sorted(rng.choice(range(total + 1)) for _ in range(rng.randint(0, 5))) + [total]
        got, cross = T.allocate(np.array(ends), np.array(bounds), rule)
        want = brute(ends, bounds, rule)
        assert np.allclose(got, want[0]) and cross == want[1]


def test_token_frame(spark):
    import base64

    import tiktoken

    with open(TIK, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "a\n\n\nb", "é\nword word\n", "<|endoftext|>\n" * 3, "x" * 30_000]
    df = spark.createDataFrame([(i, t, f"title {i}", "clash") for i, t in enumerate(texts)], "doc_id long, text string, title string, sections string")
    for rule in T.RULES:
        for r in T.count_tokens(df, TIK, public_tokenizers.PATTERN, rule, ("title", "text")).collect():
            whole = f"title {r.doc_id}" + (texts[r.doc_id] or "")
            ids = enc.encode_ordinary(whole)
            assert r.n_tokens == len(ids) and abs(sum(s.tokens for s in r.sections) - len(ids)) < 1e-9 and abs(sum(r.field_tokens) - len(ids)) < 1e-9
            ends = np.cumsum([len(enc.decode_single_token_bytes(i)) for i in ids])
            lines = [len(x.encode()) for f in (f"title {r.doc_id}", texts[r.doc_id] or "") for x in T.line_sections(f)]
            want, cross = brute(ends.tolist(), np.cumsum(lines).tolist(), rule)
            assert np.allclose([s.tokens for s in r.sections], want) and r.n_crossing == cross
    assert T.count_tokens(df.where("false"), TIK, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(df, TIK, public_tokenizers.PATTERN, "other")
