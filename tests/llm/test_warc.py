import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyscan.llm.warc import archive, lookup, parse_record, read_captures, record, url_key


def brute(rows):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for page, payload in payloads:
        same = [p for p, other in payloads if other == payload and p is not None]
        last = max(same, default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = last is not None and page != last
        out.append((page, len(payload), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_keys():
    assert url_key("http://a.Example.org:80/x?y=1#z") == "org,example,a)/x?y=1"
    assert url_key("https://example.org:8443") == "org,example:8443)/"
    assert [url_key(u) for u in (None, "", "no url", "http://[bad")] == ["", "", "no url", "http://[bad"]


def test_record_round_trip():
    payload = b"WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\x00"
    found = parse_record(record(3, "http://x/\r\nEvil: 1", payload, None, False, "2020-01-01T00:00:00Z"))
    assert found["payload"] == payload and "evil" not in found and found["page-id"] == "3"
    with pytest.raises(ValueError):
        parse_record(record(3, None, payload, None, False, "2020-01-01T00:00:00Z")[:-1])


ROWS = [(i, f"http://host{i % 3}.example.org/{i % 7}", f"page {i % 11} é\r\n\r\n") for i in range(300)]
ROWS += [(400, None, None), (401, "", ""), (402, "http://hot/", ""), (None, "http://hot/", "x"), (None, "http://hot/", "x"),
         (403, "http://hot/", "x" * 300000), (403, "http://hot/", "x" * 300000), (404, "not a url", "\x00"), (405, "http://é.fr/ü?\n", "y")]


@pytest.mark.parametrize("block_lines,archive_bytes", [(1, 1), (7, 500), (1000, 1 << 30)])
def test_read_back(spark, block_lines, archive_bytes):
    pages = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], "page_id long, url string, html string, page int, file string")
    captures, parts = archive(pages, block_lines=block_lines, archive_bytes=archive_bytes)
    found = read_captures(lookup(captures, parts))
    got = sorted((tuple(r) for r in found.select("page", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute(ROWS)
    some = captures.where("page % 10 = 0").select("key", "page").union(spark.createDataFrame([(b"zz", 1), (b"", 5)], "key binary, page long"))
    assert {r.page for r in lookup(some, parts).collect()} == {p for p, *_ in ROWS if p is not None and p % 10 == 0}


def test_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "v", "abc")], "page_id long, url string, html string")
    captures, parts = archive(pages, min_bytes=3)
    got = {(r.page, r.record_type, r.refers_to) for r in read_captures(lookup(captures, parts)).collect()}
    assert got == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    captures, parts = archive(pages)
    assert read_captures(lookup(captures.where(F.lit(True)), parts)).collect() == []
