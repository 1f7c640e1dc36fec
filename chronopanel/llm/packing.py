"""Best-fit packing by the configuration linear program over the length histogram.

Distributed: tokenising, the histogram, ranking pieces within a length and
placing them. On the driver: only the histogram, of at most ``capacity`` rows at
any size of the input, and the plan made from it. The LP (cover every length's
count with configurations, that is multisets of lengths that fit a sequence, by
as few of them as can be) is solved by multiplicative weights: lengths carry
prices, a knapsack dynamic program over all open lengths finds the configurations of the
highest price, and what they cover of a length lowers its price. Prices over the
best configuration's price are a dual solution, whose value bounds the number
of sequences from below. Shares are rounded down to whole sequences and what is
left over goes best-fit, longest first, into the gaps and into new sequences, as counts of equal bins.
If the plan is not within ``gap`` of the bound then, configurations and prices are
weighed against each other over all configurations so far (``balance``), and the
prices found ask the dynamic program for more of them, until it has none to add.
The best plan is taken, and best-fit alone is one of them, so none is worse than that.
"""

from __future__ import annotations

import bisect
import os
import string
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, spread, stage_table, with_text_ids

CAPACITY = 4096
END_ID = 1
PIECES = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of words as little-endian bytes; this vocabulary drops white space, so words can be encoded one by one.

    White space of ASCII neither joins nor composes with what is beside it, and a
    run of punctuation behind a letter is a piece of its own, so a word's stem and
    its closing punctuation are encoded apart. Words that aren't known yet go to
    the tokenizer in batches. Long words aren't kept, and the table starts anew when full.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters alone are one piece each, so many go through as one text that is cut at closing ids."""
        plain = [w for w in words if w.isalpha() and max(w) <= "\xff"]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        other = [w for w in words if w not in self.known]
        for at in range(0, len(other), 5000):
            some = other[at : at + 5000]
            for w, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = np.array(got.ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        cut, new = {}, set()
        for w in words:
            stem = w.rstrip(string.punctuation)
            if stem != w and stem and stem[-1].isascii() and stem[-1].isalpha() and "|>" not in w:
                cut[w] = stem
                new.add(stem)
                new.add(w[len(stem) :])
            else:
                new.add(w)
        self._encode_words(list(new.difference(self.known)))
        known = self.known
        for w, stem in cut.items():
            known[w] = known[stem] + known[w[len(stem) :]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = {"": b""}
        split, missing, find = [], set(), self.known.get
        for text in texts:
            text = text or ""
            for c in "\t\n\r":
                text = text.replace(c, " ")
            try:
                text.encode("latin-1")
                if "<|" not in text:  # special tokens go by their case
                    text = text.lower()  # as the vocabulary does; other scripts are left to it
            except UnicodeEncodeError:
                pass
            words = text.split(" ")
            got = list(map(find, words))
            new = set(compress(words, map(not_, got)))
            new.discard("")
            missing |= new
            split.append((got, words if new else None))
        self._learn(missing)
        out = [b"".join(got if words is None else [g or self.known[w] for g, w in zip(got, words, strict=True)]) for got, words in split]
        for w in missing:
            if len(w) > 40:
                del self.known[w]
        return out


_words: dict[str, WordIds] = {}


def _encoded(words: WordIds, texts: list[str | None]) -> Iterator[bytes]:
    """In slices of about a megabyte of text."""
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t or "")
        if size >= 1 << 20:
            yield from words.encode(now)
            now, size = [], 0
    if now:
        yield from words.encode(now)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only beyond ``capacity``.

    A null or empty text is the end id alone. Rows that repeat are separate documents. A null id is kept.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        if path not in _words:
            _words[path] = WordIds(path)
        for part in parts:
            out = []
            for doc, ids in zip(part[id_col], _encoded(_words[path], list(part[text_col])), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(out, columns=[id_col, "piece", "start", "length", "ids_crc32"])

    return with_text_ids(docs.select(id_col, text_col), run, id_col, PIECES)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the highest total price that fits, lengths as often as they fit, and the length to take first (0: none)."""
    dense = np.full(capacity + 1, -np.inf)
    dense[lengths] = prices
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    least, few = int(lengths.min(initial=capacity + 1)), len(lengths) < capacity // 8
    down = lengths[::-1]  # of equal values the longest length is taken
    value = prices[::-1]
    for room in range(least, capacity + 1):
        if few:
            at = len(down) - int(np.searchsorted(lengths, room, "right"))
            total = value[at:] + best[room - down[at:]]
            j = int(total.argmax())
            top, size = total[j], int(down[at + j])
        else:
            total = dense[room:0:-1] + best[:room]
            j = int(total.argmax())
            top, size = total[j], room - j
        if top > best[room - 1] + 1e-12:
            best[room], first[room] = top, size
        else:
            best[room] = best[room - 1]
    return best, first


def _take(first: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if first[room]:
            out.append(int(first[room]))
            room -= int(first[room])
        else:
            room -= 1
    return out


def solve_lp(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int, rate: float = 2.0, step: float = 0.5, slack: float = 0.02) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray, float]:
    """Configurations (lengths, longest first) and how many whole sequences of each; what they leave; the dual bound of the first prices.

    A round prices all open lengths with one dynamic program. Beside the best
    configuration it yields the best one that holds each length; all within
    ``slack`` of the best are used, each for ``step`` of its scarcest length. A round
    that can't use any closes the lengths it asked too much of, so rounds end by themselves.
    """
    need, left = counts.astype(np.float64), counts.copy()
    at = np.full(capacity + 1, -1)
    at[lengths] = np.arange(len(lengths))
    prices, open_ = prices.astype(np.float64).copy(), counts > 0
    used: dict[tuple[int, ...], int] = {}
    bound = 0.0
    while open_.any():
        own = np.flatnonzero(open_)
        best, first = knapsack(lengths[own], prices[own], capacity)
        if not bound:
            bound = float((need * prices).sum() / best[capacity]) * (1 - 1e-6)  # rounding stays below the bound
        value = prices[own] + best[capacity - lengths[own]]
        order = own[np.lexsort((-lengths[own], -value))][: int((value >= (1 - slack) * best[capacity]).sum())]
        progress, short = False, set()
        for i in order.tolist():
            if left[i] < 1:
                continue
            chosen = tuple(sorted([int(lengths[i]), *_take(first, capacity - int(lengths[i]))], reverse=True))
            kinds, times = np.unique(at[list(chosen)], return_counts=True)
            most = int((left[kinds] // times).min())
            if not most:
                short.update(kinds[left[kinds] < times].tolist())
                continue
            n = most if most < 4 else int(most * step)
            used[chosen] = used.get(chosen, 0) + n
            left[kinds] -= n * times
            prices[kinds] *= np.exp(-rate * n * times / need[kinds])
            progress = True
        open_ &= left > 0
        if not progress:
            open_[list(short)] = False
    return list(used.items()), left, bound


def balance(cover: np.ndarray, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Shares of configurations and weights of lengths in the game ``cover`` (lengths, configurations): what a configuration covers of a length's count.

    Both sides move by multiplicative weights, each against the other's last
    two moves, and the averages are returned. Steps fit the size of the entries, so that
    a game goes on in ``rounds`` more with half the error.
    """
    m, k = cover.shape
    scale = cover.max(0).mean()
    log_x, log_y, sum_x, sum_y = np.zeros(k), np.zeros(m), np.zeros(k), np.zeros(m)
    old_x, old_y = np.zeros(k), np.zeros(m)
    for t in range(rounds):
        x, y = np.exp(log_x - log_x.max()), np.exp(log_y - log_y.max())
        x, y = x / x.sum(), y / y.sum()
        if 2 * t >= rounds:  # the first half is far from balance
            sum_x += x
            sum_y += y
        gain, loss = y @ cover, cover @ x
        log_x += (2 * gain - old_x) / scale
        log_y -= (2 * loss - old_y) / scale
        old_x, old_y = gain, loss
    return sum_x / sum_x.sum(), sum_y / sum_y.sum()


class Group:
    """``count`` equal sequences: (length, times, first rank of its length) in order, and what room is left."""

    __slots__ = ("count", "room", "runs")

    def __init__(self, count: int, room: int, runs: list[tuple[int, int]]):
        self.count, self.room, self.runs = count, room, runs


def best_fit(lengths: np.ndarray, counts: np.ndarray, groups: list[Group], capacity: int) -> list[Group]:
    """Puts the pieces, longest first, each into the sequences with the least room that it fits, or into new ones."""
    groups = list(groups)
    by_room: dict[int, list[Group]] = {}
    for g in groups:
        by_room.setdefault(g.room, []).append(g)
    rooms = sorted(by_room)

    def offer(g: Group) -> None:
        if g.room not in by_room:
            bisect.insort(rooms, g.room)
            by_room[g.room] = []
        by_room[g.room].append(g)

    def put(g: Group) -> None:
        groups.append(g)
        offer(g)

    for i in np.argsort(-lengths, kind="stable"):
        size, n = int(lengths[i]), int(counts[i])
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # open new sequences
                each = min(capacity // size, n)
                put(Group(n // each, capacity - each * size, [(size, each)]))
                n -= n // each * each
                continue
            room = rooms[at]
            g = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = max(1, min(room // size, n // g.count))
            if n < g.count:  # only some of these sequences get one
                put(Group(g.count - n, room, g.runs))
                g.count = n
            g.runs = [*g.runs, (size, each)]
            g.room = room - each * size
            n -= each * g.count
            offer(g)
    return groups


def number(groups: list[Group]) -> int:
    return sum(g.count for g in groups)


def _plan(configurations: list[tuple[tuple[int, ...], int]], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[Group]:
    """Whole sequences of each configuration, never more than there are pieces for; the rest best-fit."""
    left, at, plan = counts.copy(), {int(s): i for i, s in enumerate(lengths)}, []
    for chosen, n in sorted(configurations, key=lambda x: (-x[1], x[0])):
        kinds, times = np.unique([at[s] for s in chosen], return_counts=True)
        n = min(n, int((left[kinds] // times).min()))
        if n > 0:
            left[kinds] -= n * times
            plan.append(Group(n, capacity - sum(chosen), [(int(lengths[k]), int(t)) for k, t in zip(kinds, times, strict=True)]))
    return best_fit(lengths, left, plan, capacity)


def pack_histogram(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, gap: float = 0.002, cells: int = 4_000_000, **lp) -> tuple[list[Group], float]:
    """The plan, groups of equal sequences that hold exactly ``counts`` pieces of each of ``lengths``, and the lower bound it was held against.

    ``cells`` bounds the memory of a game; with more lengths and configurations than that the first solution stands.
    """
    keep = counts > 0
    lengths, counts = np.asarray(lengths)[keep].astype(np.int64), np.asarray(counts)[keep].astype(np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    if not len(lengths):
        return [], 0.0
    groups, bound = best_fit(lengths, counts, [], capacity), float(counts[2 * lengths > capacity].sum())
    pool = {tuple(sorted((s for s, t in g.runs for _ in range(t)), reverse=True)) for g in groups}
    used, _, dual = solve_lp(lengths, counts, lengths / capacity, capacity, **lp)
    bound, plan = max(bound, dual), _plan(used, lengths, counts, capacity)
    groups = plan if number(plan) <= number(groups) else groups
    pool |= {c for c, _ in used}
    at = {int(s): i for i, s in enumerate(lengths)}
    while number(groups) > np.ceil(bound - 1e-9) * (1 + gap) and len(pool) * len(lengths) <= cells:
        configurations = sorted(pool)
        cover = np.zeros((len(lengths), len(configurations)))
        for j, c in enumerate(configurations):
            np.add.at(cover[:, j], [at[s] for s in c], 1.0)
        cover /= counts[:, None]
        share, weight = balance(cover)
        prices = weight / counts
        best, first = knapsack(lengths, prices, capacity)
        bound = max(bound, float((1 - 1e-6) / best[capacity]))  # the weights sum up to one
        total = 1 / (cover @ share).min()
        plan = _plan([(c, int(total * x)) for c, x in zip(configurations, share, strict=True)], lengths, counts, capacity)
        groups = plan if number(plan) < number(groups) else groups
        value = prices + best[capacity - lengths]
        new = {tuple(sorted([int(s), *_take(first, capacity - int(s))], reverse=True)) for s, v in zip(lengths, value, strict=True) if v > (1 - 1e-4) * best[capacity]} - pool
        if not new or total <= bound * (1 + gap):
            break
        pool |= new
    return groups, bound


def slots_of(groups: list[Group]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, base sequence, times, offset) in the order of length and rank; number of sequences."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for g in groups:
        offset = 0
        for size, times in g.runs:
            first = used.get(size, 0)
            rows.append((size, first, base, times, offset))
            used[size] = first + times * g.count
            offset += size * times
        base += g.count
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], base


def place(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = 64, seed: int = 17, **lp) -> DataFrame:
    """Pieces (with ``length`` and whatever else) -> plus sequence_id and offset, gapless from 0 in each sequence.

    Pieces of a length are ranked by a hash in buckets, so that a length that
    holds a third of all pieces is ranked by many tasks. No pieces, no rows.
    """
    pieces = stage_table(pieces.withColumn("_h", spread(F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.lit(seed))), "pieces")
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    sizes = np.array(sorted((r["length"], r["n"]) for r in found), np.int64).reshape(-1, 2)
    table, _ = slots_of(pack_histogram(sizes[:, 0], sizes[:, 1], capacity, **lp)[0])
    ranked = running(pieces, ["length"], "_h", ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank", buckets).drop("_h")
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # its rows follow the lengths and configurations, not the input

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        begins = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        for part in parts:
            size, rank = part["length"].to_numpy(), part["_rank"].to_numpy()
            at = np.empty(len(part), np.int64)
            for s in np.unique(size):
                own = size == s
                a, b = begins[s], begins[s + 1]
                at[own] = a + np.searchsorted(plan[a:b, 1], rank[own], "right") - 1
            nth = rank - plan[at, 1]
            yield part.drop(columns="_rank").assign(sequence_id=plan[at, 2] + nth // plan[at, 3], offset=plan[at, 4] + nth % plan[at, 3] * size)

    rest = ", ".join(f"`{c}` {t}" for c, t in ranked.drop("_rank", "doc_id").dtypes)
    ranked = ranked.select("doc_id", *[c for c in ranked.columns if c != "doc_id"])
    return with_text_ids(ranked, run, "doc_id", f"{rest}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, **lp) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(tokenize(docs, path, capacity, end_id), capacity, **lp)
