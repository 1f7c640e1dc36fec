"""Token counts by field or section, each document encoded once.

Byte-level tokens partition the text's UTF-8 bytes, so a running sum of their
lengths gives every token's span. The spans are joined to the sections' spans by
position, and a token that crosses a boundary is allocated by a stated rule:

``start``     to the section that holds its first byte;
``majority``  to the section with most of its bytes, the earlier one of equals;
``split``     to each section in proportion to its bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import with_text_ids

RULES = ("start", "majority", "split")
_loaded: dict[str, tuple] = {}


def encoder(path: str, pattern: str):
    """The encoding and the length in bytes of each id; loaded once in each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(x) for x in ranks]
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens that end at ``ends`` (bytes), over sections that end at ``bounds``: tokens of each section, tokens that cross.

    ``bounds`` ascends; equal neighbours are empty sections, which get none.
    """
    n = len(bounds)
    if not len(ends):
        return np.zeros(n, np.float64), 0
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    cross = first != last
    if rule == "start" or not cross.any():
        return np.bincount(first, minlength=n).astype(np.float64), int(cross.sum())
    out = np.bincount(first[~cross], minlength=n).astype(np.float64)
    for a, b, i, j in zip(starts[cross], ends[cross], first[cross], last[cross], strict=True):
        cuts = np.clip(bounds[i : j + 1], a, b)
        cuts[-1] = b
        share = np.diff([a, *cuts])
        if rule == "majority":
            out[i + int(share.argmax())] += 1
        else:
            out[i : j + 1] += share / (b - a)
    return out, int(cross.sum())


def line_sections(text: str) -> list[str]:
    """Lines, each with the line feed that ends it."""
    return [x + "\n" for x in text.split("\n")[:-1]] + [text.rpartition("\n")[2]]


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "majority", fields: tuple[str, ...] = ("text",), id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_crossing, field_tokens, sections: array<struct<field, section, bytes, tokens>>) for each row.

    The fields are joined without a separator and encoded as one text; sections
    are the lines of each field. Null fields are empty; an empty text has one
    empty section and no tokens. Rows are independent and may repeat; a null id is
    kept, other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, lengths = encoder(path, pattern)
        for part in parts:
            n_tokens, n_cross, by_field, sections = [], [], [], []
            for values in zip(*[part[f"_f{i}"] for i in range(len(fields))], strict=True):
                texts = [x or "" for x in values]
                lines = [line_sections(x) for x in texts]
                ends = np.cumsum(lengths[np.asarray(enc.encode_ordinary("".join(texts)), np.int64)])
                sizes = np.array([len(s.encode()) for x in lines for s in x], np.int64)
                got, cross = allocate(ends, np.cumsum(sizes), rule)
                owner = np.repeat(np.arange(len(fields)), [len(x) for x in lines])
                n_tokens.append(len(ends))
                n_cross.append(cross)
                by_field.append(np.bincount(owner, got, len(fields)))
                nth = np.arange(len(got)) - np.searchsorted(owner, owner)
                sections.append([{"field": f, "section": s, "bytes": b, "tokens": t} for f, s, b, t in zip(owner.tolist(), nth.tolist(), sizes.tolist(), got.tolist(), strict=True)])
            yield pd.DataFrame({id_col: part[id_col], "n_tokens": n_tokens, "n_crossing": n_cross, "field_tokens": by_field, "sections": sections})

    chosen = docs.select(id_col, *[docs[f].alias(f"_f{i}") for i, f in enumerate(fields)])
    return with_text_ids(chosen, run, id_col, "n_tokens long, n_crossing long, field_tokens array<double>, sections array<struct<field:int,section:int,bytes:long,tokens:double>>")
