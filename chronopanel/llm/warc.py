"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, frames into bundles; a
bundle ends with the seek table of the public seekable format (a skippable
frame with each frame's compressed and raw size and a footer). The index maps a
record's identifier to bundle, frame, offset in the unpacked frame and length.

Bundles are rows of a table (``data`` is a whole archive, usable as a
``.warc.zst`` file), so any store Spark can write to will do, a task that runs
twice leaves one committed copy, and a lost executor costs a recomputation.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
BUNDLES = "bundle string, data binary, page_ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, size: int, sha: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of its payload but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """Grows by records; ``close`` gives the archive and its index."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.done: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.raw = self.packed = 0
        self.index: list[tuple[int | None, int, int, int]] = []

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.raw and self.raw + len(raw) > self.frame_bytes:
            self.flush()
        self.index.append((page_id, len(self.done), self.raw, len(raw)))
        self.open.append(raw)
        self.raw += len(raw)

    def flush(self) -> None:
        if self.open:
            frame = self.zip.compress(b"".join(self.open))
            self.sizes.append((len(frame), self.raw))
            self.done.append(frame)
            self.packed += len(frame)
            self.open, self.raw = [], 0

    def close(self) -> tuple:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        data = b"".join(self.done) + struct.pack("<II", SKIPPABLE, len(table)) + table
        ids, frames, offsets, lengths = zip(*self.index, strict=True)
        return hashlib.sha1(data).hexdigest(), data, list(ids), list(frames), list(offsets), list(lengths)


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    each = 12 if flags & 0x80 else 8
    at, out = 0, []
    for i in range(n):
        packed, raw = struct.unpack_from("<II", data, len(data) - 9 - (n - i) * each)
        out.append((at, packed, raw))
        at += packed
    return out


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """Random access: unpack one frame and slice one record."""
    start, packed, raw = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=raw)[offset : offset + length]


def with_revisits(pages: DataFrame, min_size: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> plus sha, payload_bytes, refers_to; html of revisits is null.

    Only digests of repeated payloads are joined back, and the page side of that
    join may be split by AQE when one payload holds many rows.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", "html").withColumns({"sha": F.sha1(F.encode(html, "UTF-8")), "payload_bytes": F.octet_length(html).cast("long")})
    first = (
        pages.where(F.col("payload_bytes") >= min_size).groupBy("sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").select(F.col("sha").alias("_sha"), "_first")
    )
    pages = pages.join(first, F.col("sha") == F.col("_sha"), "left")
    again = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return pages.withColumn("refers_to", again).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html"))).drop("_sha", "_first")


def write_bundles(pages: DataFrame, frame_bytes: int = 1 << 17, bundle_bytes: int = 4 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows of ``with_revisits`` -> one row for each bundle (lazy; stage it before reading it twice).

    ``bundle`` is the SHA-1 of the archive. Null page_ids and urls are kept as null; no pages, no bundles.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, now = ["bundle", "data", "page_ids", "frames", "offsets", "lengths"], None
        for part in parts:
            for page_id, url, html, sha, size, refers in zip(part.page_id, part.url, part.html, part.sha, part.payload_bytes, part.refers_to, strict=True):
                page_id, refers = None if pd.isna(page_id) else int(page_id), None if pd.isna(refers) else int(refers)
                now = now or Bundle(frame_bytes, level)
                sha32 = base64.b32encode(bytes.fromhex(sha)).decode()
                now.add(page_id, record(page_id, None if pd.isna(url) else url, b"" if pd.isna(html) else html.encode(), refers, int(size), sha32, date))
                if now.packed >= bundle_bytes:
                    yield pd.DataFrame([now.close()], columns=names)
                    now = None
        if now:
            yield pd.DataFrame([now.close()], columns=names)

    ids = pages.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return ids.mapInPandas(run, BUNDLES)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Bundles -> records, through each bundle's seek table and index.

    A response's digest and size are taken from the payload that was read; a
    mismatch with its header raises. A revisit's are those its header states.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for part in parts:
            for row in part.itertuples(index=False):
                table, at, frame, out = seek_table(row.data), -1, b"", []
                for k, offset, length in zip(row.frames, row.offsets, row.lengths, strict=True):
                    if k != at:
                        start, packed, raw = table[k]
                        at, frame = k, unzip.decompress(row.data[start : start + packed], max_output_size=raw)
                    fields, http, payload = parse(frame[offset : offset + length])
                    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
                    out.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, len(payload) if kind == "response" else int(http["Content-Length"]), sha, number(fields.get("WARC-Refers-To")), payload if payloads else None))
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                got = pd.DataFrame(out, columns=names)
                yield got.astype({"page_id": "Int64", "refers_to": "Int64"})

    return bundles.mapInPandas(run, RECORDS)


def round_trip(pages: DataFrame, min_size: int = 0, payloads: bool = True) -> DataFrame:
    """Write every page as a WARC record into bundles in the shared folder, then read all back.

    Defined cases: a null html is an empty payload; pages that tie on the largest
    page_id of equal payloads are all responses; a null page_id or url is kept as
    null; other columns are ignored; no pages give no records.
    """
    from .common import stage_table

    return read_bundles(stage_table(write_bundles(with_revisits(pages, min_size)), "warc"), payloads)


def locate(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The index rows (bundle, page_id, frame, offset, length) of some pages, without their archives' data.

    Repeated ids give the rows once; ids that no bundle has, and null, give none.
    """
    index = bundles.select("bundle", F.posexplode("page_ids").alias("_i", "page_id"), "frames", "offsets", "lengths")
    index = index.select("bundle", "page_id", F.get("frames", "_i").alias("frame"), F.get("offsets", "_i").alias("offset"), F.get("lengths", "_i").alias("length"))
    return index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi").select("bundle", "page_id", "frame", "offset", "length")


def fetch(bundles: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``locate`` -> (bundle, page_id, record): each record's bytes, from its frame alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [read_record(*x) for x in zip(part["data"], part["frame"], part["offset"], part["length"], strict=True)]
            yield part[["bundle", "page_id"]].assign(record=got)

    rows = found.join(bundles.select("bundle", "data").dropDuplicates(["bundle"]), "bundle")
    return rows.mapInPandas(run, "bundle string, page_id long, record binary")
