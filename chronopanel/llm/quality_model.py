"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are covered by overlapping chunks. Learned filters over
an embedding of the bytes run along each chunk, each filter's highest response
in a chunk is kept, and the mean of the chunks' logits gives one probability.

Training takes at most ``most_docs`` labelled documents and of each at most
``most_bytes``, in pieces spread over all of it (the documented bounds of the
sample); scoring reads every byte of every document in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED, FILTERS, WIDTH, STRIDE = 8, 16, 6, 2
#: Positions in a half chunk; a chunk is two neighbouring halves, so chunks overlap by half.
HALF = 128
MOST_DOCS, MOST_BYTES, EPOCHS = 1500, 4096, 14
HOLD_OUT, CUT = 5, 0.3


def held_out(doc_id: Column) -> Column:
    """A null id counts as an empty text, whose remainder is 0: held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HOLD_OUT == 0


def to_bytes(text: str | None) -> np.ndarray:
    return filled((text or "").encode())


def filled(raw: bytes) -> np.ndarray:
    """Bytes with zeros behind them, up to a filter's width and to whole strides, so that a filter covers the last byte."""
    size = max(WIDTH, -(-(len(raw) - WIDTH) // STRIDE) * STRIDE + WIDTH)
    return np.frombuffer(raw.ljust(size, b"\0"), np.uint8)


def halves_of(n: int) -> int:
    return -(-((n - WIDTH) // STRIDE + 1) // HALF)


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """(positions, filters): each byte's share is looked up in a table made of embedding and filter."""
        tables = np.einsum("be,wef->wbf", self.embed, self.filters)
        n = (len(raw) - WIDTH) // STRIDE + 1
        total = np.repeat(self.bias[None], n, 0)
        for j in range(WIDTH):
            total += tables[j][raw[j : j + (n - 1) * STRIDE + 1 : STRIDE]]
        return total

    def pooled(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The highest response of each filter in each half chunk; ``starts`` are positions where halves begin."""
        return np.maximum.reduceat(self.responses(raw), starts, 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of label 1. A slice of texts goes through the filters at once, separate documents in separate halves."""
        out = np.zeros(len(texts))
        now, size, done = [], 0, 0
        for t in texts:
            now.append(to_bytes(t))
            size += len(now[-1])
            if size >= 1 << 18:
                out[done : done + len(now)] = self._slice(now)
                done, now, size = done + len(now), [], 0
        if now:
            out[done:] = self._slice(now)
        return out

    def _slice(self, docs: list[np.ndarray]) -> np.ndarray:
        parts = []
        for raw in docs:
            long = len(raw) * FILTERS * 4 > 64 << 20
            parts.append(self._long(raw) if long else None)
        few = [d for d, p in zip(docs, parts, strict=True) if p is None]
        logits = iter(self._logits(few)) if few else iter(())
        return 1 / (1 + np.exp(-np.array([next(logits) if p is None else p for p in parts], np.float64)))

    def _logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Documents end to end at even places; positions across a seam are left out of the halves."""
        sizes = np.array([len(d) + len(d) % STRIDE for d in docs])
        raw = np.zeros(sizes.sum() + WIDTH, np.uint8)
        at = np.cumsum(sizes) - sizes
        for d, a in zip(docs, at, strict=True):
            raw[a : a + len(d)] = d
        got = self.responses(raw)
        n = np.array([(len(d) - WIDTH) // STRIDE + 1 for d in docs])
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        got = got[np.repeat(at // STRIDE, n) + place]
        halves = np.array([halves_of(len(d)) for d in docs])
        ends = np.cumsum(halves)
        first = np.flatnonzero(place % HALF == 0)
        top = np.maximum.reduceat(got, first, 0)
        return self._combine(top, halves, ends)

    def _combine(self, top: np.ndarray, halves: np.ndarray, ends: np.ndarray) -> np.ndarray:
        last = np.zeros(len(top), bool)
        last[ends - 1] = True
        chunk = np.where(last[:, None], top, np.maximum(top, np.concatenate([top[1:], top[-1:]])))
        # the last half closes the chunk before it; alone it is the document's only chunk
        keep = ~last
        keep[ends[halves == 1] - 1] = True
        owner = np.repeat(np.arange(len(halves)), halves)
        logit = np.maximum(chunk, 0) @ self.out + self.base
        return np.bincount(owner[keep], logit[keep], len(halves)) / np.maximum(halves - 1, 1)

    def _long(self, raw: np.ndarray) -> float:
        """A very long document in stretches of whole halves."""
        n = (len(raw) - WIDTH) // STRIDE + 1
        each = HALF * 512
        tops = []
        for a in range(0, n, each):
            b = min(n, a + each)
            tops.append(self.pooled(raw[a * STRIDE : (b - 1) * STRIDE + WIDTH], np.arange(0, b - a, HALF)))
        top = np.concatenate(tops)
        return float(self._combine(top, np.array([len(top)]), np.array([len(top)]))[0])

    def gradient(self, raw: np.ndarray, label: int) -> tuple[float, list[np.ndarray]]:
        """Loss of one document and its gradient, which passes through each filter's highest place in each chunk."""
        got = self.responses(raw)
        starts = np.arange(0, len(got), HALF)
        if len(starts) > 1:
            spans = [(a, min(a + 2 * HALF, len(got))) for a in starts[:-1]]
        else:
            spans = [(0, len(got))]
        where = np.stack([a + got[a:b].argmax(0) for a, b in spans])  # (chunks, filters)
        top = np.take_along_axis(got, where, 0)
        active = np.maximum(top, 0)
        logit = float((active @ self.out).mean() + self.base[0])
        p = 1 / (1 + np.exp(-logit))
        d = np.float32((p - label) / len(spans))
        grad_out = d * active.sum(0)
        back = d * self.out[None] * (top > 0)  # (chunks, filters)
        seen = raw[where[..., None] * STRIDE + np.arange(WIDTH)]  # (chunks, filters, width)
        vectors = self.embed[seen]
        grad_filters = np.einsum("cf,cfwe->wef", back, vectors)
        grad_vectors = np.einsum("cf,wef->cfwe", back, self.filters)
        grad_embed = np.zeros_like(self.embed)
        np.add.at(grad_embed, seen, grad_vectors)
        loss = -np.log(max(p if label else 1 - p, 1e-12))
        return loss, [grad_embed, grad_filters, back.sum(0), grad_out, np.array([p - label], np.float32)]

    def fit(self, docs: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 16, seed: int = 4) -> Network:
        """Adam over shuffled batches; label 0, the rarer one, weighs up to three times as much."""
        rng = np.random.default_rng(seed)
        share = max(1, sum(labels)) / max(1, len(labels) - sum(labels))
        weight = np.where(np.array(labels) == 0, min(3.0, max(1.0, share)), 1.0)
        m = [np.zeros_like(x) for x in self.parameters()]
        v = [np.zeros_like(x) for x in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(docs), batch):
                grads = [np.zeros_like(x) for x in self.parameters()]
                own = order[a : a + batch]
                for i in own:
                    for g, x in zip(grads, self.gradient(docs[i], labels[i])[1], strict=True):
                        g += x * np.float32(weight[i] / len(own))
                step += 1
                now = rate * (1 - epoch / epochs)
                for x, g, a1, a2 in zip(self.parameters(), grads, m, v, strict=True):
                    a1 *= 0.9
                    a1 += 0.1 * g
                    a2 *= 0.999
                    a2 += 0.001 * g * g
                    x -= np.float32(now) * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-7)
        return self


def train(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES, epochs: int = EPOCHS) -> Network:
    """A network from at most ``most_docs`` labelled documents that aren't held out, chosen by a hash of doc_id.

    A third of the sample is kept for label 0. Without labels the network is
    untrained. Null ids and null labels are never learned from; of several labels of an id the
    greatest counts, and of several rows of an id the text of the least bytes.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    sample = known.where("quality = 0").orderBy(*order).limit(most_docs // 3).unionByName(known.where("quality = 1").orderBy(*order).limit(most_docs - most_docs // 3))
    rows = docs.select("doc_id", F.col("text")).join(F.broadcast(sample), "doc_id")  # at most most_docs rows
    rows = rows.withColumn("text", F.encode("text", "UTF-8"))
    n = F.octet_length("text")
    piece = F.lit(512)
    at = lambda i: F.floor((n - piece) * i / F.lit(most_bytes // 512 - 1)).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(most_bytes // 512 - 1)), lambda i: F.hex(F.substr(F.col("text"), at(i) + 1, piece))), "")
    rows = rows.select("doc_id", "quality", F.when(n <= most_bytes, F.hex("text")).otherwise(spread).alias("raw"))
    got = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("raw").alias("raw")).collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    net = Network()
    if got:
        raws = [filled(bytes.fromhex(r["raw"] or "")) for r in got]
        net.fit(raws, [r["quality"] for r in got], epochs)
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs plus the score; null and empty texts get the score of an empty document. Rows are independent."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 20 KB at any size of the input

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.scores(list(part)))

    return docs.withColumn(out, run(F.col(text_col)))
