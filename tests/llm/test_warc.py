import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from quillwork.llm import warc
from quillwork.plans.materialize import fresh_path

SCHEMA = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("file", "length", "refers_to", "_sha", "_n")})


ROWS = [
    (1, "http://www.Example.com:80/a?x=1#f", "<p>same</p>"), (2, "https://b.example.org/", "<p>same</p>"), (2, "https://b.example.org/", "<p>same</p>"), (3, None, None), (4, "", ""),
    (5, "http://example.com/a b\nc", "é\r\n\r\nWARC/1.1\r\n\r\n" * 3), (None, "http://n.example/", "<p>same</p>"), (None, "http://n.example/", "alone"), (6, "http://example.com/long", "y" * 3_000_000),
    (7, "http://example.com/z", "\x00\x01" + "".join(chr(random.Random(1).randrange(32, 0xD7FF)) for _ in range(5000))),
]


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, k in rows if (k or "").encode() == data and j is not None]
        revisit = len([1 for _, _, k in rows if (k or "").encode() == data]) > 1 and len(data) >= least and same and i != max(same)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    assert sorted((tuple(r) for r in warc.round_trip(pages(spark, ROWS)).collect()), key=str) == brute(ROWS)


def test_small_payloads_are_stored(spark):
    assert sorted((tuple(r) for r in warc.round_trip(pages(spark, ROWS), revisit_bytes=100).collect()), key=str) == brute(ROWS, 100)


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_archives_index_and_lookup(spark):
    rows = [(i, f"http://h{i % 9}.example.com/{i % 50}", f"<p>{i}</p>" * (i % 5 + 1)) for i in range(200)] + ROWS
    path = fresh_path(spark, "warc-test")
    warc.write(pages(spark, rows), path, archive_bytes=4096)
    data = [bytes(r.content) for r in warc.archives(spark, path).collect()]
    assert len(data) > 3
    # Whole archives are valid gzip files of one record after the other.
    assert sum(gzip.decompress(d).count(b"WARC-Record-ID:") for d in data) == len(rows)
    blocks = warc.build_index(warc.captures(spark, path), block_lines=10).cache()
    assert blocks.agg(F.sum("lines")).first()[0] == len(rows) and blocks.agg(F.max("lines")).first()[0] <= 10
    directory = warc.Directory(blocks)
    assert directory.first == sorted(directory.first)
    for url in ("http://h3.example.com/3", "http://EXAMPLE.com/a?x=1", "http://h0.example.com/0"):
        want = sorted(str(i) for i, u, _ in rows if warc.url_key(u) == warc.url_key(url))
        assert sorted(str(r["page_id"]) for r in warc.find(spark, directory, url)) == want and want
    assert warc.find(spark, directory, "http://nobody.example/") == []


def test_damage_is_noticed():
    import pytest

    raw = warc.record(1, "http://a/", b"payload", "response", None)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paylaod"))


def test_url_keys():
    assert warc.url_key("https://www.Sub.Example.com:443/P?q") == "com,example,sub)/P?q"
    assert warc.url_key("http://a.b:8080") == "b,a:8080)/"
    assert warc.url_key(None) == ")/"
