import base64
import gzip
import hashlib

import pytest

from lotline.llm import warc
from lotline.storage import new_folder

SCHEMA = "page_id bigint, url string, html string, payload string"


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        body = (html or "").encode()
        if page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        low = first.get(body)
        own = low is None or low == page
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "response" if own else "revisit", None if own else low))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/é ü\r\nX: y", "<p>é</p>", "odd"),
    (2, None, None, "odd"),
    (3, "http://b", "", "odd"),
    (4, "http://c", "x" * 300_000, "odd"),
    (5, "http://d", "<p>é</p>", "odd"),
    (5, "http://d", "<p>é</p>", "odd"),
    (0, "http://e", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "odd"),
    (None, "http://f", "<p>é</p>", "odd"),
    (None, "http://g", "only null ids", "odd"),
    *[(100 + i, "http://h", "copy", "odd") for i in range(300)],
]


def test_pages_come_back(spark):
    got = warc.round_trip(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_header_predicates_are_pushed_and_small_ranges_lose_nothing(spark):
    path = new_folder(spark, "test-warc")
    warc.write_pages(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path)
    everything = warc.read(spark, path)
    assert everything.count() == len(ROWS)
    assert warc.read(spark, path, splitBytes="700").count() == len(ROWS)
    some = everything.where("record_type = 'revisit' AND page_id IN (101, 102, 4)")
    assert sorted(r.page_id for r in some.collect()) == [101, 102]
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString().split("RelationV2")[0]
    assert all(r.payload is None for r in warc.read(spark, path, payload="false").collect())


def test_records_are_gzip_members_that_others_can_read():
    row = {"page_id": 7, "url": "http://a", "payload": b"body", "payload_bytes": 4, "sha1": hashlib.sha1(b"body").hexdigest(), "refers_to_page": None}
    raw = warc.record(row, "2020-01-01T00:00:00Z")
    assert gzip.decompress(warc.member(raw)) == raw
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nbody\r\n\r\n")


def test_foreign_archives(spark, tmp_path):
    """Members without a length, a plain file, other record types, and a payload that does not fit its digest."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    digest = base64.b32encode(hashlib.sha1(b"abc").digest())
    page = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (digest, len(block), block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page) + gzip.compress(page))
    (tmp_path / "b.warc").write_bytes(info + page)
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_type, r.payload) for r in got) == [("response", b"abc")] * 3 + [("warcinfo", b"hello")] * 2
    assert warc.read(spark, f"file://{tmp_path}").where("record_type = 'response'").count() == 3
    (tmp_path / "c.warc").write_bytes(page.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read(spark, f"file://{tmp_path}").collect()
