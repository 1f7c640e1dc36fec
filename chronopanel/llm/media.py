"""Baseline JPEG media columns: lossless storage of bytes, DC-only luminance thumbnails, hashes.

``store`` writes one payload byte as the DC term of one 8x8 block (quantiser 8,
so the block's mean is the byte), 64 blocks to a row and a restart marker after
each row. ``thumbnails`` reads any baseline JPEG: it parses the markers and
Huffman-decodes the scans of many images at once, one numpy lane for each
restart segment, and keeps the DC terms of the luminance.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import with_text_ids

WIDE = 64
MAX_ROWS = 8191  # of blocks: 65,528 pixels, the format's limit being 65,535
#: Bytes of payload that are encoded or decoded at a time.
SLICE = 2 << 20


def _dht(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    body = bytes([kind]) + bytes(lengths) + bytes(symbols)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


# Category c has a code of 9 - c bits and c more bits: nine bits for any difference. The end of block takes one.
_DC = _dht(0x00, [1] * 9 + [0] * 7, list(range(8, -1, -1)))
_AC = _dht(0x10, [1] + [0] * 15, [0])
_DQT = b"\xff\xdb" + struct.pack(">H", 67) + b"\0" + bytes([8] * 64)
_DRI = b"\xff\xdd" + struct.pack(">HH", 4, WIDE)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)


def _codes() -> np.ndarray:
    """Ten bits for each difference from -255 to 255, at difference + 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = ((1 << (8 - c)) - 1) << 1  # 8 - c ones and a zero
        extra = d if d >= 0 else d + (1 << c) - 1
        out[d + 255] = ((prefix << c) | extra) << 1
    return out


_CODES = _codes()


def _head(rows: int) -> bytes:
    return b"\xff\xd8" + _DQT + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, rows * 8, WIDE * 8, 1, 1, 0x11, 0) + _DC + _AC + _DRI + _SOS


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 64 bytes, as one JPEG, or as several on end beyond MAX_ROWS rows."""
    pieces = [(i, p[at : at + MAX_ROWS * WIDE]) for i, p in enumerate(payloads) for at in range(0, len(p), MAX_ROWS * WIDE)]
    rows = np.array([len(p) // WIDE for _, p in pieces])
    grid = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).reshape(-1, WIDE).astype(np.int16)
    diff = np.empty_like(grid)
    diff[:, 0] = grid[:, 0] - 128
    np.subtract(grid[:, 1:], grid[:, :-1], out=diff[:, 1:])
    bits = _CODES[diff + 255].reshape(-1, WIDE // 4, 4)
    five = (bits[..., 0] << 30) | (bits[..., 1] << 20) | (bits[..., 2] << 10) | bits[..., 3]
    coded = np.empty((len(grid), WIDE // 4 * 5 + 2), np.uint8)
    coded[:, :-2] = five.astype(">u8").view(np.uint8).reshape(len(grid), WIDE // 4, 8)[..., 3:].reshape(len(grid), -1)
    ends = np.cumsum(rows)
    coded[:, -2] = 0xFF
    coded[:, -1] = 0xD0 + (np.arange(len(grid)) - np.repeat(ends - rows, rows)) % 8
    coded[ends - 1, -1] = 0xD9  # the last row ends the image
    stuffed = coded[:, :-2] == 0xFF
    each = coded.shape[1]
    at = np.flatnonzero(stuffed)
    at = at + at // (each - 2) * 2  # where it is with the markers
    flat = np.insert(coded.ravel(), at + 1, 0)
    size = np.cumsum(rows * each + np.add.reduceat(stuffed.sum(1), ends - rows))
    out: list[list[bytes]] = [[] for _ in payloads]
    for (i, _), n, a, b in zip(pieces, rows, [0, *size[:-1]], size, strict=True):
        out[i] += [_head(int(n)), flat[a:b].tobytes()]
    return [b"".join(x) for x in out]


class Image(NamedTuple):
    width: int
    height: int
    tables: tuple  # what the scan's decoding depends on
    quant: int  # of the luminance's DC
    restart: int
    scan: bytes


def parse(data: bytes) -> Iterator[Image]:
    """The images that stand on end in ``data``. Progressive, arithmetic and 12-bit ones raise."""
    at, dht, dqt, restart, frame = 0, {}, {}, 0, None
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD9:
            if kind == 0xD8:
                dht, dqt, restart, frame = {}, {}, 0, None
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                dqt[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 129 if wide else 65
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                dht[body[k]] = bytes(body[k + 1 : k + 17 + n])
                k += 17 + n
        elif kind in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples are read")
            frame = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline images are read")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        at += 2 + size
        if kind == 0xDA:
            used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            end = data.find(b"\xff\xd9", at)
            width, height, parts = frame
            if body[0] != len(parts):
                raise ValueError("only images of one scan are read")
            one = len(parts) == 1
            layout = tuple((1 if one else h, 1 if one else v, dht[used[c] >> 4], dht[0x10 | used[c] & 15]) for c, h, v, _ in parts)
            yield Image(width, height, layout, dqt[parts[0][3]], restart, data[at : end if end >= 0 else len(data)])
            at = end if end >= 0 else len(data)


def _symbols(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + length of its code; 0 where there is none."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = table[k] * 32 + n
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _block(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For each 16 bits ahead that hold a whole block without AC terms: (difference + 4096) * 32 + its bits; else 0."""
    ahead = np.arange(1 << 16)
    c, n = dc >> 5, dc & 31
    bits = n + c
    fits = (n > 0) & (bits < 16)
    raw = np.where(fits, (ahead >> np.clip(16 - bits, 0, 16)) & ((1 << c) - 1), 0)
    diff = np.where((c > 0) & (raw < (1 << np.maximum(c - 1, 0))), raw - (1 << c) + 1, raw)
    rest = (ahead << np.clip(bits, 0, 16)) & 0xFFFF
    end = ac[rest]
    fits &= (end >> 5 == 0) & (end & 31 > 0) & (bits + (end & 31) <= 16)
    return np.where(fits, (diff + 4096) * 32 + bits + (end & 31), 0)


_tables: dict[tuple, tuple] = {}


def _of(dc: bytes, ac: bytes) -> tuple:
    if (dc, ac) not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        d, a = _symbols(dc), _symbols(ac)
        _tables[dc, ac] = d, a, _block(d, a)
    return _tables[dc, ac]


def _peek(words: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (words[pos >> 3] >> (8 - (pos & 7))) & 0xFFFF


def _slow(words: np.ndarray, pos: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block with AC terms, in each lane: its difference, where it ends."""
    got = dc[_peek(words, pos)]
    if not (got & 31).all():
        raise ValueError("bits that are no code")
    pos, c = pos + (got & 31), got >> 5
    raw = np.where(c > 0, _peek(words, pos) >> np.clip(16 - c, 0, 16), 0)
    diff = np.where((c > 0) & (raw < (1 << np.maximum(c - 1, 0))), raw - (1 << c) + 1, raw)
    pos = pos + c
    k, todo = np.ones(len(pos), np.int64), np.arange(len(pos))
    while len(todo):
        got = ac[_peek(words, pos[todo])]
        if not (got & 31).all():
            raise ValueError("bits that are no code")
        run, bits = got >> 9, (got >> 5) & 15
        pos[todo] += (got & 31) + bits
        k[todo] = np.where(bits > 0, k[todo] + run + 1, np.where(run == 15, k[todo] + 16, 64))
        todo = todo[k[todo] < 64]
    return diff, pos


def _scans(images: list[Image]) -> list[np.ndarray]:
    """DC-only luminance of images that share their tables, in levels of 0 to 255."""
    layout = images[0].tables
    h, v = layout[0][:2]
    wide = [-(-im.width // (8 * max(t[0] for t in layout))) for im in images]
    high = [-(-im.height // (8 * max(t[1] for t in layout))) for im in images]
    raw = np.frombuffer(b"".join(im.scan for im in images) + bytes(8), np.uint8)
    starts = np.cumsum([0, *[len(im.scan) for im in images]])[:-1]
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    gone = ff[after == 0] + 1
    marks = ff[(after >= 0xD0) & (after <= 0xD7)] + 2
    plain = np.delete(raw, gone)
    words = plain.astype(np.uint32)
    words[:-2] = (words[:-2] << 16) | (words[1:-1] << 8) | words[2:]
    words = words.astype(np.int64)
    begins = np.sort(np.concatenate([starts, marks]))
    owner = np.searchsorted(starts, begins, "right") - 1
    nth = np.arange(len(begins)) - np.searchsorted(begins, starts)[owner]
    total = np.array(wide)[owner] * np.array(high)[owner]
    each = np.array([im.restart for im in images])[owner]
    mcus = np.where(each > 0, np.clip(total - nth * each, 0, np.maximum(each, 1)), total)
    order = np.argsort(-mcus, kind="stable")
    pos = (begins - np.searchsorted(gone, begins))[order] * 8
    left = mcus[order]
    most = int(left[0]) if len(left) else 0
    plan = [(i == 0, *_of(dc, ac)) for i, (a, b, dc, ac) in enumerate(layout) for _ in range(a * b)]
    out = np.zeros((most * h * v, len(pos)), np.int32)
    lanes = len(left) - np.searchsorted(left[::-1], np.arange(most), "right")
    row = 0
    for m in range(most):
        n = lanes[m]
        for luma, dc, ac, block in plan:
            at = pos[:n]
            got = block[_peek(words, at)]
            if got.all():
                at += got & 31
                diff = (got >> 5) - 4096
            else:
                diff, slow = (got >> 5) - 4096, np.flatnonzero(got == 0)
                ends = at + (got & 31)
                diff[slow], ends[slow] = _slow(words, at[slow], dc, ac)
                at[:] = ends
            if luma:
                out[row, :n] = diff
                row += 1
    level = np.empty_like(out)
    level[:, order] = np.cumsum(out, 0)
    quant = np.array([im.quant for im in images])[owner]
    level = np.clip((level * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    result = []
    ends = np.searchsorted(owner, np.arange(len(images)), "right")
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        flat = level[:, a].copy() if b == a + 1 else level[:, a:b].T.ravel()
        flat = flat[: wide[i] * high[i] * h * v]
        grid = flat.reshape(high[i], wide[i], v, h).swapaxes(1, 2).reshape(high[i] * v, wide[i] * h)
        part = max(t[0] for t in layout), max(t[1] for t in layout)
        result.append(grid[: -(-images[i].height * v // (8 * part[1])), : -(-images[i].width * h // (8 * part[0]))])
    return result


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each column value its images: width, height, one level for each 8x8 block of luminance."""
    groups, out = defaultdict(list), [[] for _ in media]
    for i, data in enumerate(media):
        for im in parse(data):
            groups[im.tables].append((i, len(out[i]), im))
            out[i].append((im.width, im.height, None))
    for found in groups.values():
        for (i, k, im), grid in zip(found, _scans([x[2] for x in found]), strict=True):
            out[i][k] = (im.width, im.height, grid)
    return out


def average_hash(grid: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 mean thumbnail are above the mean; the same on any machine, being integers."""
    for axis in (0, 1):
        n = grid.shape[axis]
        edges = np.arange(8) * n // 8
        sums = np.add.reduceat(grid.astype(np.int64), edges, axis) if n >= 8 else np.take(grid.astype(np.int64), edges, axis)
        sizes = np.diff([*edges, n]) if n >= 8 else np.ones(8, np.int64)
        grid = (sums * 1024) // (sizes[:, None] if axis == 0 else sizes[None, :])
    return int.from_bytes(np.packbits((grid * 64 > grid.sum()).ravel()).tobytes(), "big")


def feature(images: list[tuple[int, int, np.ndarray]]) -> str:
    return ";".join(f"{w}x{h}:{average_hash(grid):016x}" for w, h, grid in images)


def _slices(values: list[bytes]) -> Iterator[list[bytes]]:
    now, size = [], 0
    for x in values:
        now.append(x)
        size += len(x)
        if size >= SLICE:
            yield now
            now, size = [], 0
    if now:
        yield now


def pad(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def add_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the UTF-8 of each text, filled with bytes 0 up to a multiple of 64, as JPEG.

    A null or empty text fills one row of blocks. Equal texts give equal media. A null id is kept; other columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = [len(x.encode()) if x else 0 for x in part[text_col]]
            done = 0
            for some in _slices([pad(x) for x in part[text_col]]):
                yield pd.DataFrame({id_col: part[id_col].iloc[done : done + len(some)], "n_bytes": sizes[done : done + len(some)], "media": store(some)})
                done += len(some)

    return with_text_ids(docs.select(id_col, text_col), run, id_col, "n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode stored media: digests of the bytes read back, dimensions, thumbnail hashes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = 0
            for some in _slices(list(part["media"])):
                out = []
                for data, images in zip(some, thumbnails(some), strict=True):
                    payload = b"".join(grid.tobytes() for _, _, grid in images)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(images), images[0][0], images[0][1]))
                got = pd.DataFrame(out, columns=[x.split()[0] for x in FEATURES.split(", ")])
                got.insert(0, id_col, part[id_col].iloc[done : done + len(some)].to_numpy())
                got.insert(1, "n_bytes", part["n_bytes"].iloc[done : done + len(some)].to_numpy())
                done += len(some)
                yield got

    return with_text_ids(media.select(id_col, "n_bytes", "media"), run, id_col, f"n_bytes long, {FEATURES}")
