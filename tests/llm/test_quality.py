import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import quality_model as Q
from chronopanel.llm import quality_rules as R

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "é", "😀", " ", "  ", "\n", "\t", "\x0b", "#", "$", "\xa0"]) for _ in range(rng.randint(0, 120))) for _ in range(300)] + [None, "", " ", "a b c a b c a b c", "x " * 5000]
    df = spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r[s] for s in R.STATS) for r in R.text_statistics(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def mcd(points, floors, steps):
    """The same estimates in numpy: of all starts the half with the least determinant."""
    x, floor = np.array(points, float), np.array(floors) * R.SCALE
    middle = np.array([np.sort(c)[int(np.ceil(0.5 * len(c))) - 1] for c in x.T])
    spread = lambda y: np.cov(y.T, bias=True) + np.diag(floor**2)
    starts = [(middle, np.diag((floor * w) ** 2)) for w in (np.ones(4), np.array([1, 10, 1, 10]), np.array([10, 1, 10, 1]))] + [(x.mean(0), spread(x))]
    best = None
    for mu, cov in starts:
        for _ in range(steps):
            d = np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(cov), x - mu)
            bins = np.floor(np.log2(d + 1e-3) * 16)
            half = x[bins <= np.sort(bins)[int(np.ceil(0.5 * len(bins))) - 1]]
            mu, cov = half.mean(0), spread(half)
        if best is None or np.linalg.det(cov) < np.linalg.det(best[1]) * (1 - 1e-8):
            best = mu, cov
    mu, cov = best
    return np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(cov), x - mu)


def test_outliers_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for lang, source, n in (("en", "a", 300), ("en", None, 80), ("de", "a", 90), ("de", "small", 9)):
        vectors = np.round(rng.normal(0, [200, 300, 400, 500], (n, 4)) + rng.normal(0, 900, 4)).astype(int)
        vectors[: n // 10] += 6000
        vectors[n // 10 : n // 3, 1:] += 1500
        for v in vectors:
            rows.append((len(rows), lang, source, False, *map(int, v)))
    rows += [(10_000, "en", "a", True, 0, 0, 0, 0)]
    group = {None: lambda r: r[2] is None, "a": lambda r: r[1:3] == ("en", "a"), "de": lambda r: r[1:3] == ("de", "a"), "all de": lambda r: r[1] == "de"}
    for name, member in group.items():  # the small group is judged by its language
        own = [r for r in rows if member(r) and not r[3]]
        for r, d in zip(own, mcd([r[4:] for r in own], R.FLOORS, R.STEPS), strict=True):
            if name != "all de" or r[2] == "small":
                want[r[0]] = d
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, base_failed boolean, _x0 long, _x1 long, _x2 long, _x3 long")
    got = {r.doc_id: r for r in R.judge(df, [F.col(f"_x{i}") for i in range(4)]).collect()}
    assert len(got) == len(rows) == len(want) + 1 and got[10_000].distance is None and not got[10_000].kept
    for k, d in want.items():
        assert abs(got[k].distance - d) <= 1e-3 * max(1, d) and got[k].kept == (got[k].distance <= R.CUT)


def test_halves_of_short_and_long_histograms_agree(spark):
    rng = random.Random(8)
    rows = [(g, int(rng.gauss(0, width))) for g, width in ((1, 2), (2, 900), (3, 0)) for _ in range(151)] + [(4, -7)]
    rows += [(5, 64 * k) for k in range(4)] + [(6, 5), (6, 700)]
    df = spark.createDataFrame(rows, "g int, bin long")
    for share in (0.5, 0.25, 1.0):
        sums = {r.g: (r.m, r.s0, int(r.p00)) for r in R._half(df.withColumn("x0", F.col("bin")), ["g"], 1, share).collect()}
        limits = {r.g: r.limit for r in R._half_of_many(df, ["g"], share).collect()}
        want = {g: sorted(x for k, x in rows if k == g) for g in {g for g, _ in rows}}
        assert limits == {g: xs[int(np.ceil(share * len(xs))) - 1] for g, xs in want.items()}
        halves = {g: [x for x in xs if x <= limits[g]] for g, xs in want.items()}
        assert sums == {g: (len(xs), sum(xs), sum(x * x for x in xs)) for g, xs in halves.items()}
    assert R._half_of_many(df.limit(0), ["g"], 0.5).count() == 0


def test_no_column_of_the_user_is_lost(spark):
    names = ["x0", "mu0", "l00", "g_lang", "g_source", "_x0", "_words", "_twice", "__x0", "_n"]
    rows = [(i, f"some {i} words " * 30, "en", "s", *range(10)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    out = R.apply_rules(df)
    assert out.columns == [*df.columns, *R.STATS, "base_failed", "distance", "kept"]
    assert {tuple(r)[4:14] for r in out.collect()} == {tuple(range(10))}


def test_rules_frame(spark):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(120))
    junk = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) + "###" for _ in range(120))
    rows = [(i, good(), "en", "s") for i in range(100)] + [(500 + i, junk(), "en", "s") for i in range(20)] + [(900, None, None, None), (901, "short", "en", None), (902, "a b c " * 60, "en", "s"), (903, good(), None, "rare"), (903, good(), None, "rare")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = R.apply_rules(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {*range(100), 903}
    assert R.apply_rules(df.where("false")).count() == 0


def test_repetitive_texts_are_outliers(spark):
    """Of 20 to 45 percent of words in repeated windows, or of repeated lines, beside clean texts with the odd repeat."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    words = lambda n: [word() for _ in range(n)]
    again = lambda n: words(2) + (x := words(n)) + words(90 - n) + x + words(108 - n)  # noqa: E731  n of 100 words repeat

    def lines(n):  # of 24 lines of five words n come twice
        own = [" ".join(words(5)) for _ in range(24 - n)]
        return "\n".join(own + own[:n])

    clean = [(i, " ".join(again(rng.choice([0, 0, 0, 0, 3, 6])) if i % 2 else words(120)), "en", "s") for i in range(150)]
    repeats = [(1000 + n, " ".join(again(n)), "en", "s") for n in range(22, 46, 3)]
    doubled = [(2000 + n, lines(n), "en", "s") for n in (3, 4, 5)]
    got = R.apply_rules(spark.createDataFrame([(*r, "clash") for r in clean + repeats + doubled], SCHEMA)).collect()
    share = {r.doc_id: r.n_repeat_words / r.n_words for r in got}
    assert all(0.2 <= share[r[0]] <= 0.5 for r in repeats) and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in clean}


def test_each_dimension_can_reject():
    """A text that the base rule keeps can lie beyond the cut by its repeats alone, or by its lines alone."""
    assert (R.MAX_REPEAT / 100) / R.FLOORS[2] ** 2 > R.CUT and np.log1p(20 * 0.1) ** 2 / R.FLOORS[3] ** 2 > R.CUT


def test_steps_end_when_halves_stay(spark):
    rng = np.random.default_rng(18)
    points = np.concatenate([rng.normal(0, 400, (300, 4)), rng.normal(900, 400, (200, 4))]).round().astype(int)
    rows = spark.createDataFrame([("g", *map(int, v)) for v in points], "g string, x0 long, x1 long, x2 long, x3 long")
    ends = [tuple(R.mcd(rows, ["g"], 4, *steps).first()) for steps in ((), (R.STEPS + 1,), (3,))]
    assert ends[0] == ends[1] != ends[2]


def test_no_plan_of_the_rules_has_python(spark, monkeypatch):
    plans, stage = [], R.stage_table
    monkeypatch.setattr(R, "stage_table", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stage(df, name))
    plans.append(R.apply_rules(spark.createDataFrame([(1, "a b " * 40, "en", "s", "")], SCHEMA))._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))


def test_every_byte_counts_and_scores_equal_a_plain_network():
    """Each window of each chunk by loops, whatever the length."""
    net = Q.Network(5)
    rng = random.Random(6)
    texts = ["", "a", "abcdefg", "abcdefX", *["".join(rng.choice("abcdé") for _ in range(n)) for n in (6, 7, 8, 300, 301, 511, 515, 777, 1500)]]
    for text, got in zip(texts, net.scores(texts), strict=True):
        raw = list(text.encode())
        raw += [0] * (6 - len(raw)) if len(raw) < 6 else [0] * (len(raw) % 2)
        tops = [net.bias + sum(net.embed[raw[i + j]] @ net.filters[j] for j in range(6)) for i in range(0, len(raw) - 5, 2)]
        tops = [np.max(tops[a : a + Q.HALF], 0) for a in range(0, len(tops), Q.HALF)]
        chunks = [np.maximum(a, b) for a, b in zip(tops, tops[1:], strict=False)] or tops
        logit = np.mean([np.maximum(c, 0) @ net.out + net.base[0] for c in chunks])
        assert abs(got - 1 / (1 + np.exp(-logit))) < 1e-4
    for n in (7, 301, 4097):  # a last byte of another value changes a strong enough filter's response
        net.filters[:] = 0
        net.filters[5 if n % 2 == 0 else 4] = 1
        net.embed[:] = 0
        net.embed[ord("X")] = 5
        one, other = net.scores(["a" * n, "a" * (n - 1) + "X"])
        assert one != other


@pytest.fixture(scope="module")
def net():
    return Q.Network()


def test_gradient(net):
    rng = np.random.default_rng(8)
    raw = rng.integers(0, 256, 900).astype(np.uint8)
    _, grads = net.gradient(raw, 1)
    for p, g in zip(net.parameters(), grads, strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[k], np.float32(1e-2)
        losses = []
        for delta in (eps, -eps):
            p[k] = old + delta
            losses.append(net.gradient(raw, 1)[0])
        p[k] = old
        assert abs((losses[0] - losses[1]) / (2 * eps) - g[k]) <= 0.05 * abs(g[k]) + 1e-3


def test_scores_cover_whole_texts_alike(net):
    """In slices, alone and in stretches, and as the training pass sees it."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcé #") for _ in range(n)) for n in (0, 1, 5, 6, 7, 250, 257, 258, 511, 512, 513, 770, 3000)] + [None]
    got = net.scores(texts)
    for text, score in zip(texts, got, strict=True):
        raw = Q.to_bytes(text)
        assert abs(net.scores([text])[0] - score) < 1e-6
        assert abs(1 / (1 + np.exp(-net._long(raw))) - score) < 1e-6
        loss, _ = net.gradient(raw, 1)
        assert abs(np.exp(-loss) - score) < 1e-5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = Q.train(docs, labels)
    scored = Q.score(docs.select("doc_id", "text"), net).join(labels, "doc_id").where(Q.held_out(F.col("doc_id"))).toPandas()
    pos, neg = scored[scored.quality == 1].score, scored[scored.quality == 0].score
    assert len(neg) > 3 and (pos.to_numpy()[:, None] > neg.to_numpy()[None]).mean() > 0.95
    assert ((scored.score >= Q.CUT) == (scored.quality == 1)).mean() > 0.9


def test_training_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "é", "z")], "doc_id long, text string, score string").drop("score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (4, 1)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, labels, epochs=1)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(docs.where("false"), Q.train(docs, labels.where("false"))).count() == 0
