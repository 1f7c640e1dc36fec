"""Byte-pair encoding and decoding by forced boundaries.

A pair of bytes that stands side by side in no token of the vocabulary can never
be merged, so a text may be cut between them: the fragments are encoded each on
its own and their ids put together. Fragments are short and repeat much, so each
is encoded once and then looked up; a text of any length is never one long merge.

The cut must not change what the splitting rule in front of the merges sees
either. That rule makes runs of letters, of digits and of other characters, each
with at most one space before it, takes apostrophe endings ('s, 're ...) as
words, and leaves the last white space of a run to what follows. So there is no
cut inside a character, after white space, before an apostrophe or inside an
apostrophe ending: elsewhere both sides split alone as they do together.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Fragments that a worker remembers, and bytes of the longest of them.
REMEMBERED, LONGEST = 1 << 18, 64
#: Rows of which a worker holds the results.
SLICE = 128
#: Endings that the splitting rule takes as words of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Code points that some Unicode version or library counts as white space.
WHITE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
WHITE_2, WHITE_3 = (np.array([int.from_bytes(b, "big") for b in (chr(c).encode() for c in WHITE) if len(b) == n]) for n in (2, 3))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Codec:
    """A byte-level vocabulary: its tokenizer for fragments, the pairs to cut at, special strings, and the bytes of each id."""

    tokenizer: object
    cuts: np.ndarray
    special: dict[str, int]
    tokens: dict[int, bytes]
    known: dict[bytes, bytes] = field(default_factory=dict)  # ids as 32-bit integers, so that a text's are one join

    def fragments(self, text: str) -> list[bytes]:
        """The text's UTF-8 bytes, cut at every forced boundary."""
        raw = text.encode()
        if len(raw) < 2:
            return [raw] if raw else []
        b = np.frombuffer(raw, np.uint8).astype(np.int32)
        at = np.flatnonzero(self.cuts[(b[:-1] << 8) | b[1:]])  # a cut comes after this byte
        if len(at) and (b[at] >= 0x80).any():
            two = (b[np.maximum(at - 1, 0)] << 8) | b[at]
            three = (b[np.maximum(at - 2, 0)] << 16) | two
            at = at[~(np.isin(two, WHITE_2) | np.isin(three, WHITE_3))]
        ends = (at + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], [*ends, len(raw)], strict=True)]

    def plain(self, text: str) -> bytes:
        """Ids, as 32-bit integers, of a text without special strings."""
        parts = self.fragments(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(parts).difference(self.known))
        for p, got in zip(new, self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False), strict=True):
            self.known[p] = np.array(got.ids, np.int32).tobytes()
        ids = b"".join(map(self.known.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return ids

    def encode(self, text: str) -> np.ndarray:
        parts = re.split(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})", text) if self.special else [text]
        return np.frombuffer(b"".join([np.int32(self.special[p]).tobytes() if p in self.special else self.plain(p) for p in parts]), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.tokens.get(i, b"") for i in ids]).decode("utf-8", "replace")


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes (first * 256 + second) whether a text may always be cut between them."""
    cuts = np.ones((256, 256), bool)
    for token in [*tokens, *[e.encode() for e in ENDINGS]]:
        for a, b in zip(token, token[1:], strict=False):
            cuts[a, b] = False
    cuts[:, 0x80:0xC0] = False  # inside a character
    cuts[[c for c in WHITE if c < 0x80], :] = False
    cuts[:, ord("'")] = False
    return cuts.reshape(-1)


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Loaded once in each Python worker. Only byte-level vocabularies of the usual splitting rule have the cuts shown above."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["normalizer"] or model.get("type", "BPE") != "BPE" or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        tokens = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        cuts = cut_table(list(tokens.values()))
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = Codec(tokenizer, cuts, {t["content"]: t["id"] for t in added}, tokens | {t["id"]: t["content"].encode() for t in added})
    return _loaded[path]


def _slices(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A few rows at a time, so that a worker never holds a whole batch's results."""
    for part in parts:
        for i in range(0, len(part), SLICE):
            yield part.iloc[i : i + SLICE]


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """All rows with ``out``, the ids (array<int>) of each whole text; special strings in a text become their ids.

    With ``decoded``, also that column: what the ids stand for, made in the same pass. Null and
    empty texts have no ids. Rows are independent and may repeat, other columns
    stay as they are; columns that have the new ones' names are replaced.
    """

    @F.pandas_udf("ids array<int>, text string" if decoded else "ids array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in _slices(parts):
            got = [own.encode(t or "") for t in part]
            yield pd.DataFrame({"ids": got} | ({"text": [own.decode(x.tolist()) for x in got]} if decoded else {}), dtype=object)

    new, = unused(df.columns, "encoded")
    df = df.withColumn(new, ids(F.col(f"`{text_col}`")))
    return df.withColumns({out: F.col(new)["ids"]} | ({decoded: F.col(new)["text"]} if decoded else {})).drop(new)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows with ``out``, the text that the ids stand for, special ones included; bytes that aren't UTF-8 become U+FFFD.

    A null array gives the empty text; null and unknown ids are left out.
    """

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for part in _slices(parts):
            yield pd.Series([own.decode([] if x is None else x.tolist()) for x in part], dtype=object)

    return df.withColumn(out, texts(F.col(f"`{ids_col}`")))
