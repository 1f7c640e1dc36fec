"""Near-duplicate documents by BagMinHash signatures of five-word shingle multisets.

Each register takes the earliest point of Poisson processes over (shingle,
discretised weight): the weight axis is cut into dyadic levels [0, 1), [1, 2),
[2, 4), ..., each with points of its own in the order of time, and a point counts
for a shingle of weight w if its position on the axis is below w. Registers of
two documents agree with the probability of their weighted Jaccard similarity.
Signatures are banded, candidates' multiset overlap is verified exactly, and
verified links are joined to classes.

Exact copies are one vertex from the start. A bucket is never turned into all
its pairs. First each member is compared with one leader, the member that shares
most buckets, which joins most of a large group to one class. Pairs of a bucket
that are left in different classes then need a second reason to be compared: two
multisets that overlap enough must share one of their rarest shingles, each within
a prefix whose length follows from both sizes. Shingles that only one text has fill
such prefixes first, so unlike members of a large group meet no longer. The prefix
rule is exact: no pair at or above the threshold that shares a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
#: Ratio of sizes within one band of the prefix join.
SIZE_STEP = 1.03
#: What a null doc_id counts as.
NO_ID = 2**63 - 1
#: Words hashed at a time, at least one document.
SLICE = 400_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64 bits of each word, kept for short words up to a number of them."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(word) <= 40:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHash()


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles(docs: list[list[str]], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' shingles, sorted within each, and how many each has.

    A document of fewer words than a shingle has one of all its words, and none has none.
    """
    out, sizes = [], np.zeros(len(docs), np.int64)
    powers = [np.uint64(pow(_BASE, width - 1 - j, 1 << 64)) for j in range(width)]
    for i, words in enumerate(docs):
        n = len(words)
        if not n:
            continue
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
        if n < width:
            total = 0
            for x in h.tolist():
                total = (total * _BASE + x + n) % (1 << 64)
            got = np.array([total], np.uint64)
        else:
            got = h[: n - width + 1] * powers[0]
            for j in range(1, width):
                got += h[j : n - width + 1 + j] * powers[j]
            got.sort()
        out.append(got)
        sizes[i] = len(got)
    return (mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)), sizes


def weighted(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: hash, weight, document."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), owner
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(new)
    return hashes[at], np.diff([*at, len(hashes)]), owner[at]


def bag_minhash(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int, m: int, seed: int = 1) -> np.ndarray:
    """(n_docs, m) identifiers of the earliest accepted points; documents without shingles keep zeros."""
    out = np.zeros((n_docs, m), np.uint64)
    todo = np.unique(owner)
    slack = 4.0
    total = np.bincount(owner, weights, n_docs)
    while len(todo):
        horizon = np.zeros(n_docs)
        horizon[todo] = (np.log(m) + slack) / total[todo]
        best = np.full(n_docs * m, np.inf)
        winner = np.zeros(n_docs * m, np.uint64)
        live = np.isin(owner, todo) if len(todo) < n_docs else slice(None)
        h, w, doc = hashes[live], weights[live], owner[live]
        level, low, width = 0, 0, 1
        while len(h):
            state = mix64(h + np.uint64((seed * 131 + level) * 0x9E3779B97F4A7C15 % (1 << 64)))
            top, d, time = w, doc, np.zeros(len(h))
            end = horizon[d]
            while len(state):
                state = state + _GOLD
                u = mix64(state)
                time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740993.0) / (m * width)
                on = time <= end
                state, top, d, time, end, u = state[on], top[on], d[on], time[on], end[on], u[on]
                v = mix64(u ^ _M1)
                key = d * m + (v >> np.uint64(40)).astype(np.int64) % m
                t = time
                if low + width > 1:  # of the first level every point counts
                    inside = low + width * ((v & np.uint64(0xFFFFFFFFFF)).astype(np.float64) / 2**40) < top
                    key, t, u = key[inside], time[inside], u[inside]
                np.minimum.at(best, key, t)
                won = best[key] == t
                winner[key[won]] = u[won]
            level, low, width = level + 1, low + width, max(1, low + width)
            more = w > low
            h, w, doc = h[more], w[more], doc[more]
        full = np.isfinite(best.reshape(n_docs, m)).all(1)
        ready = todo[full[todo]]
        out[ready] = winner.reshape(n_docs, m)[ready]
        todo = todo[~full[todo]]
        slack *= 3
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_docs, bands) hashes of the bands, each with its band's number in it."""
    part = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, part.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(_BASE) + part[:, :, j])
    return key


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th of equal shingles gets a hash of its own, so that set overlap is multiset overlap."""
    if not len(hashes):
        return hashes
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    at = np.flatnonzero(new)
    nth = np.arange(len(hashes)) - np.repeat(at, np.diff([*at, len(hashes)]))
    return np.where(nth > 0, mix64(hashes + nth.astype(np.uint64) * _GOLD), hashes)


def _slices(texts: list[str | None]) -> Iterator[list[list[str]]]:
    now, size = [], 0
    for t in texts:
        now.append(split_words(t))
        size += len(now[-1])
        if size >= SLICE:
            yield now
            now, size = [], 0
    if now:
        yield now


def with_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits of hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h1, h2 (of the text), n (shingles), bands."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = 0
            for some in _slices(list(part["text"])):
                own = part.iloc[done : done + len(some)]
                done += len(some)
                hashes, sizes = shingles(some, width)
                registers = bag_minhash(*weighted(hashes, sizes), len(some), bands * rows)
                keys = band_keys(registers, bands, rows).view(np.int64)
                yield pd.DataFrame({"doc_id": own["doc_id"], "h1": own["h1"], "h2": own["h2"], "n": sizes, "bands": list(keys)})

    given = with_hashes(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    return given.mapInPandas(run, "doc_id long, h1 long, h2 long, n long, bands array<long>").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def shingle_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(h1, h2, text) -> (h1, h2, items): each document's shingles as a set of occurrences."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 500):
                own = part.iloc[at : at + 500]
                hashes, sizes = shingles([split_words(t) for t in own["text"]], width)
                # sorted before mixing, so equal ones are neighbours still
                ends = np.cumsum(sizes)
                yield pd.DataFrame({"h1": own["h1"], "h2": own["h2"], "items": [occurrences(hashes[b - n : b]).view(np.int64) for b, n in zip(ends, sizes, strict=True)]})

    return docs.select("h1", "h2", "text").mapInPandas(run, "h1 long, h2 long, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (v, label) of every vertex in them; equal labels are one component.

    Vertices order by hash, so hooking each on its least neighbour and contracting
    ends after a number of rounds logarithmic in the longest path.
    """
    both = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(df.select(F.col(b).alias("a"), F.col(a).alias("b")))
    links = stage_table(both(edges, "a", "b").distinct(), "links")
    hop = stage_table(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "hop")
    labels = hop.select(F.col("a").alias("v"), F.col("to").alias("label"))
    while True:
        moved = links.join(hop, "a").select(F.col("to").alias("x"), "b").join(hop.withColumnsRenamed({"a": "b"}), "b").select("x", F.col("to").alias("y"))
        links = stage_table(both(moved.where("x != y"), "x", "y").distinct(), "links")
        if links.isEmpty():
            return labels
        hop = stage_table(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "hop")
        labels = stage_table(labels.join(hop, labels["label"] == hop["a"], "left").select("v", F.coalesce("to", "label").alias("label")), "labels")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose multisets' weighted Jaccard similarity reaches the threshold."""
    right = pairs.join(sets.select(F.col("v").alias("b"), F.col("items").alias("_b")), "b")
    joined = right.join(sets.select(F.col("v").alias("a"), F.col("items").alias("_a")), "a")
    common = F.size(F.array_intersect("_a", "_b"))
    return joined.where(common >= threshold * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def leader_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """members (v, bucket, n, shared) -> (bucket, a, v, near): every member but the leader beside its bucket's leader a.

    The leader is the member with most co-members over all its buckets, so that the
    buckets of a large group have few leaders in all. ``near`` says whether the sizes allow the threshold.
    """
    central = members.groupBy("v").agg(F.sum("shared").alias("score"))
    heads = members.join(central, "v").groupBy("bucket").agg(F.max(F.struct("score", "v", "n")).alias("_h"))
    heads = heads.select("bucket", F.col("_h.v").alias("a"), F.col("_h.n").alias("_na"))
    near = F.least("n", "_na") >= threshold * F.greatest("n", "_na")
    return members.join(heads, "bucket").where("a != v").select("bucket", "a", "v", near.alias("near"))


def _least_overlap(x: Column, y: Column, threshold: float) -> Column:
    """Overlap that multisets of x and y shingles need for the threshold."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (x + y) - 1e-9)


def prefix_pairs(left: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """left (v, label) and sets (v, items) -> pairs (a, b) of different labels that can reach the threshold.

    Shingles are ordered by the number of texts in ``left`` that have them. If the
    overlap of two texts must be o, they share a shingle that is among the first
    n - o + 1 of both. Sizes come in bands, so the larger text names the bands of
    partners that it may have and the prefix that goes with each. Shingles of one text alone take
    places but give no rows.
    """
    each = stage_table(left.join(sets, "v").select("v", "label", F.size("items").alias("n"), F.explode("items").alias("item")), "left-shingles")
    common = each.groupBy("item").agg(F.count("*").alias("_f")).where("_f > 1")
    rare = each.join(common, "item").groupBy("v", "label", "n").agg(F.sort_array(F.collect_list(F.struct("_f", "item"))).alias("known"))
    n = F.col("n")
    alone = n - F.size("known")  # these come first
    longest = n - F.ceil(F.lit(threshold) * n - 1e-9) + 1
    rare = rare.withColumn("known", F.transform(F.slice("known", F.lit(1), F.greatest(longest - alone, F.lit(0)).cast("int")), lambda x, i: F.struct(x["item"].alias("item"), (alone + i).alias("pos"))))
    band = lambda x: F.floor(F.log(x) / F.log(F.lit(SIZE_STEP))).cast("int")
    least = F.ceil(F.lit(threshold) * n - 1e-9)
    # as the smaller text in its own band, and as the larger one in each band that a partner may be of
    lowest = lambda b: F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), b)) - 1)
    small = F.array(F.struct(band(n).alias("band"), F.lit(False).alias("large"), (n - _least_overlap(n, n, threshold)).alias("last")))
    large = F.transform(F.sequence(band(F.greatest(least, F.lit(1))), band(n)), lambda b: F.struct(b.alias("band"), F.lit(True).alias("large"), (n - _least_overlap(n, lowest(b), threshold)).alias("last")))
    rows = rare.where(F.size("known") > 0).select("v", "label", "n", "known", F.explode(F.concat(small, large)).alias("r")).select("v", "label", "n", "r.*", F.explode("known").alias("k"))
    rows = stage_table(rows.where("k.pos <= last").select("v", "label", "n", "band", "large", "k.item", "k.pos"), "prefixes")
    met = rows.groupBy("item", "band").agg(F.min("label").alias("_p"), F.max("label").alias("_q"), F.bool_or("large").alias("_l"), F.bool_or(~F.col("large")).alias("_s")).where("_p != _q and _l and _s")
    rows = stage_table(rows.join(met.select("item", "band"), ["item", "band"]), "shared-prefixes")
    side = lambda large, p: rows.where(F.col("large") == large).select("item", "band", *[F.col(c).alias(f"{p}_{c}") for c in ("v", "label", "n", "pos")])
    need = _least_overlap(F.col("a_n"), F.col("b_n"), threshold)
    on = (F.col("a_label") != F.col("b_label")) & (F.col("a_n") <= F.col("b_n")) & (F.col("a_n") >= threshold * F.col("b_n") - 1e-9)
    on = on & (F.col("a_pos") + need <= F.col("a_n")) & (F.col("b_pos") + need <= F.col("b_n"))
    small_, large_ = side(False, "a"), side(True, "b").withColumnsRenamed({"item": "_item", "band": "_band"})
    pairs = small_.join(large_, (F.col("item") == F.col("_item")) & (F.col("band") == F.col("_band")) & on)
    return pairs.select(F.least("a_v", "b_v").alias("a"), F.greatest("a_v", "b_v").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id, class_h1, class_h2, n_in_class, exact_copies, h1, h2: one row for each row of docs.

    class_h1 and class_h2, the text hashes of one member, tell classes apart.
    class_id is the least doc_id of the class; unlike texts under one repeated
    or null doc_id are classes of their own with that class_id in common. Null texts count as empty; texts
    without a word are a class with their exact copies alone. Rows that repeat
    are exact copies. Null doc_ids count as the largest. Other columns are
    ignored, and no rows give no rows.
    """
    rows_ = stage_table(signatures(docs, bands, rows, width), "signatures")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    texts = rows_.groupBy("h1", "h2").agg(F.min(key).alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    texts = stage_table(texts.withColumn("v", F.struct("h1", "h2")), "texts")
    spread_ = texts.where("n > 0").select("v", "n", F.explode("bands").alias("bucket"))
    shared = spread_.groupBy("bucket").agg((F.count("*") - 1).alias("shared")).where("shared > 0")
    members = stage_table(spread_.join(shared, "bucket"), "members")
    # the texts of candidates alone, each from the row of its least doc_id: a third of the rows may be copies of one
    mine = texts.join(members.select("v").distinct(), "v", "left_semi").select("h1", "h2", F.col("least").alias("_id"))
    bodies = with_hashes(docs).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    wanted = bodies.join(mine, ["_id", "h1", "h2"], "left_semi").dropDuplicates(["_id", "h1", "h2"])
    sets = stage_table(shingle_sets(wanted, width).select(F.struct("h1", "h2").alias("v"), "items"), "shingle-sets")
    led = stage_table(leader_pairs(members, threshold), "leaders")
    pairs = led.where("near").select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")).distinct()
    links = stage_table(verify(pairs, sets, threshold), "verified")
    labels = stage_table(components(links), "labels")
    # what no leader has joined: members of different classes in one bucket
    now = led.join(labels, "v", "left").select("bucket", "v", F.coalesce("label", "v").alias("label"))
    split = now.groupBy("bucket").agg(F.min("label").alias("_p"), F.max("label").alias("_q")).where("_p != _q").select("bucket")
    left = stage_table(now.join(split, "bucket").select("v", "label").distinct(), "unresolved")
    more = stage_table(verify(prefix_pairs(left, sets, threshold), sets, threshold), "verified")
    if not more.isEmpty():
        links = stage_table(links.unionByName(more), "links")
        labels = components(links)
    classes = texts.join(labels, "v", "left").select("h1", "h2", "copies", "least", F.coalesce("label", "v").alias("label"))
    whole = classes.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("n_in_class"))
    classes = stage_table(classes.join(whole, "label").select("h1", "h2", "class_id", F.col("label.h1").alias("class_h1"), F.col("label.h2").alias("class_h2"), "n_in_class", F.col("copies").alias("exact_copies")), "classes")
    return rows_.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"])


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """Of each class of near duplicates the row of the least doc_id, then of the least text hashes, all its columns as given.

    Rows that repeat in doc_id and text become one. Classes are told apart by
    their hashes: unlike texts under one repeated or null doc_id all stay.
    """
    classes = stage_table(near_duplicates(docs, **settings), "classes")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    lead = classes.groupBy("class_h1", "class_h2").agg(F.min(F.struct(key.alias("i"), "h1", "h2")).alias("h"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")).alias("h"))
    return keyed.join(lead.select("h"), "h", "left_semi").dropDuplicates(["h"]).select("row.*")
