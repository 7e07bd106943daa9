"""Header fields are read line by line, whatever addresses hold."""

from __future__ import annotations

from gridloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_addresses_that_look_like_fields(spark, tmp_path):
    odd = ["http://a/?WARC-Type: response", "x\r\nWARC-Type: response\r\n", "http://a/application/http", "Content-Length: 9", "WARC-Record-ID: <urn:x-page:99>"]
    pages = spark.createDataFrame([(i, url, "same body") for i, url in enumerate(odd)] + [(50, odd[0], "same body"), (60, odd[2], "é" * 40)], SCHEMA)
    warc.write_archive(pages, f"{tmp_path}/a")
    records = warc.read_archive(spark, f"{tmp_path}/a")
    for r in warc.parsed(records).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert len(body) - 4 == r.content_length, head
        assert (r.record_type == "response") == (r.record_id in (50, 60))
    warc.write_files(records, f"{tmp_path}/f")
    back = {r.id: r for r in warc.read_files(spark, f"{tmp_path}/f").collect()}
    assert {i: bytes(r.record) for i, r in back.items()} == {r.id: bytes(r.record) for r in records.collect()}
    assert bytes(back[50].payload) == b"same body" and bytes(back[0].payload) == b"" and bytes(back[60].payload) == ("é" * 40).encode()


def test_other_records_of_files(spark, tmp_path):
    """A record whose header is no UTF-8, and one that only names application/http in its address."""
    record = lambda *lines, body: b"WARC/1.1\r\n" + b"".join(x + b"\r\n" for x in lines) + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    one = record(b"WARC-Type: resource", b"WARC-Target-URI: http://a/\xff\xfe", body=b"raw\r\n\r\nbody")
    two = record(b"WARC-Type: resource", b"WARC-Target-URI: http://a/application/http", b"Content-Type: text/plain", body=b"a\r\n\r\nb")
    (tmp_path / "x.warc").write_bytes(one + two)
    got = warc.read_files(spark, f"{tmp_path}/x.warc").collect()
    assert [bytes(r.record) for r in got] == [one, two]
    assert [bytes(r.payload) for r in got] == [b"raw\r\n\r\nbody", b"a\r\n\r\nb"] and all(r.id is None for r in got)
