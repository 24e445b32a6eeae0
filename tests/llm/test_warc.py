"""Round trips through bundles, seek tables and the index."""

import io

import pytest
import zstandard

from foliograph.llm import warc
from foliograph.llm.common import F


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/1", "same"), (2, "http://a/2\nx", "same"), (3, None, "same"), (3, "http://a/3", "same"), (4, "http://a/é", ""),
        (5, "u", None), (None, "u", "only"), (7, "u", "WARC/1.1\r\n\r\nlike a record\r\n\r\n"), (8, "u", "long é" * 5000), (9, "u", "only"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def test_round_trip(pages):
    bundles = warc.write_bundles(pages, frame_bytes=300, bundle_bytes=700)
    got = {(r.page_id, r.url): r for r in warc.read_bundles(bundles).collect()}
    assert len(got) == pages.count()
    assert [got[k].record_type for k in ((1, "http://a/1"), (2, "http://a/2%0Ax"), (3, None), (3, "http://a/3"))] == ["revisit", "revisit", "response", "response"]
    assert got[1, "http://a/1"].refers_to == 3 and got[1, "http://a/1"].payload_bytes == 4
    assert (got[4, "http://a/é"].refers_to, got[5, "u"].record_type) == (5, "response")
    assert got[None, "u"].refers_to == 9
    for key, text in (((7, "u"), "WARC/1.1\r\n\r\nlike a record\r\n\r\n"), ((8, "u"), "long é" * 5000), ((5, "u"), "")):
        assert bytes(got[key].payload) == text.encode()
        assert got[key].payload_digest == warc.base32_sha1(text.encode())


def test_least_size(pages):
    kinds = {r.page_id: r.record_type for r in warc.read_bundles(warc.write_bundles(pages, min_bytes=5)).collect()}
    assert set(kinds.values()) == {"response"}


def test_any_reader_reads_a_bundle_and_index_finds_records(spark, pages):
    bundles = warc.write_bundles(pages, frame_bytes=300, bundle_bytes=2000)
    for b in bundles.collect():
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b.data), read_across_frames=True).read()
        assert stream == b"".join(warc.frame(bytes(b.data), p) for p in warc.seek_table(bytes(b.data)))
        for entry in b["index"]:
            raw = warc.frame(bytes(b.data), warc.seek_table(bytes(b.data))[entry.frame])[entry.offset:entry.offset + entry.length]
            assert f"WARC-Record-ID: {entry.record_id}".encode() in raw
    wanted = spark.createDataFrame([("<urn:page:8>",), ("<urn:page:>",), ("<urn:page:99>",)], "record_id string")
    assert sorted(str(r.page_id) for r in warc.fetch(bundles, wanted).collect()) == ["8", "None"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(empty)).count() == 0


def test_damage_is_found():
    raw = warc.record(1, "u", b"abc", False, None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))
