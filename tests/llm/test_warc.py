import base64
import hashlib

from chronopanel.llm import warc
from chronopanel.llm.common import stage_table

SCHEMA = "page_id long, url string, html string, payload string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_round_trip_and_revisits(spark):
    long = "ü" * 400_000
    pages = make(spark, [(1, "u1", "same"), (5, "u5", "same"), (3, None, "same"), (2, "u\r\n2", long), (7, "u7", None), (8, "u8", "")])
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 6
    assert got[5].record_type == "response" and got[5].refers_to is None and bytes(got[5].payload) == b"same"
    assert {(i, got[i].record_type, got[i].refers_to) for i in (1, 3)} == {(1, "revisit", 5), (3, "revisit", 5)}
    assert bytes(got[2].payload) == long.encode() and got[2].payload_bytes == 800_000 and got[2].url == "u%0D%0A2"
    assert got[7].record_type == "revisit" and got[8].record_type == "response" and got[3].url is None
    for r in got.values():
        want = {2: long, 7: "", 8: ""}.get(r.page_id, "same").encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode() and r.payload_bytes == len(want)


def test_min_size_empty_table_and_ties(spark):
    pages = make(spark, [(1, "a", "xx"), (2, "b", "xx"), (9, "c", "long enough"), (9, "d", "long enough"), (None, "e", "q")])
    got = sorted((str(r.page_id), r.record_type) for r in warc.round_trip(pages, min_size=5).collect())
    assert got == [("1", "response"), ("2", "response"), ("9", "response"), ("9", "response"), ("None", "response")]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_random_access_and_locate(spark):
    pages = make(spark, [(i, f"u{i}", f"text {i} " * 50) for i in range(300)])
    bundles = stage_table(warc.write_bundles(warc.with_revisits(pages), frame_bytes=4096, bundle_bytes=8192), "test-bundles")
    assert bundles.count() > 1
    row = bundles.first()
    frames = warc.seek_table(bytes(row.data))
    assert len(frames) == max(row.frames) + 1 and sum(f[1] for f in frames) < len(row.data)
    for k in (0, len(row.page_ids) - 1):
        fields, _, payload = warc.parse(warc.read_record(bytes(row.data), row.frames[k], row.offsets[k], row.lengths[k]))
        assert fields["WARC-Record-ID"] == f"<urn:page:{row.page_ids[k]}>" and payload == f"text {row.page_ids[k]} ".encode() * 50
    wanted = spark.createDataFrame([(7,), (250,), (7,), (999,), (None,)], "page_id long")
    found = warc.locate(bundles, wanted)
    assert sorted(r.page_id for r in found.collect()) == [7, 250] and bundles.select("bundle").distinct().count() == bundles.count()
    for r in warc.fetch(bundles, found).collect():
        assert warc.parse(bytes(r.record))[2] == f"text {r.page_id} ".encode() * 50
