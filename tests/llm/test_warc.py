import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc
from millrace.llm.common import fresh_path

M = warc.MARK
PAGES = [
    (1, "u", "a" + M + "b" + M), (2, None, None), (3, "x\r\ny", ""), (4, "u", M), (5, "u", "é" * 50000 + M + "z" * 70000), (5, "u", "é" * 50000 + M + "z" * 70000), (6, "u", "\r\n\r\n"), (None, "u", "q"), (None, "u", "q"),
    (7, "u", M[:6]), (8, "u", M * 2000), (9, "u", M + "WARC/1.1"), (10, "u", "\r\nWARC/1.1\r\nfoo"), (11, "u", "WARC/1.1\r\n" * 3000), (12, "u", "same"), (13, "v", "same"), (14, "w", "same"),
]


def written(spark, rows=PAGES, **options):
    path = fresh_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path, **options)
    return path


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("segment", [150, 500, 1 << 20])
def test_round_trip(spark, segment):
    rows = warc.read(spark, written(spark, segment=segment, records=50)).collect()
    key = lambda *x: tuple(map(str, x))
    whole = sorted(key(r["page_id"], hashlib.md5(bytes(r["payload"])).hexdigest()) for r in rows if r["record_type"] == "response")
    assert whole == sorted(key(i, hashlib.md5((t or "").encode()).hexdigest()) for i, _, t in PAGES if i not in (2, 12, 13))
    assert sorted((r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit") == [(2, 3), (12, 14), (13, 14)]
    assert all(r["error"] is None for r in rows) and len(rows) == len(PAGES)


def test_resolved(spark):
    rows = warc.resolved(warc.read(spark, written(spark, segment=400))).collect()
    want = sorted((str(i), len((t or "").encode()), sha1(t)) for i, _, t in PAGES)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in rows) == want


def test_ids_and_addresses_come_back_whole(spark):
    big = 9007199254740993
    pages = [(big, "http://a/<x>y", "one"), (None, "u", "two"), (big + 2, "<http://b/>", "one"), (3, None, "three"), (3, None, "three"), (4, "u", "three"), (4, "u", "three")]
    path = written(spark, pages, date="2001-02-03T04:05:06Z")
    rows = warc.read(spark, path).collect()
    key = lambda r: (str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["uri"])
    assert sorted(map(key, rows)) == sorted([
        (str(big), "revisit", str(big + 2), "http://a/<x>y"), ("None", "response", "None", "u"), (str(big + 2), "response", "None", "http://b/"),
        ("3", "revisit", "4", None), ("3", "revisit", "4", None), ("4", "response", "None", "u"), ("4", "response", "None", "u"),
    ])
    text = "".join(r["value"] + "\n" for r in spark.read.text(path).collect())
    ids = [line for line in text.replace("\r", "").split("\n") if line.startswith("WARC-Record-ID")]
    assert len(set(ids)) == len(ids) == len(pages) and text.count("WARC-Date: 2001-02-03T04:05:06Z") == len(pages)
    refers = {line.split(": ", 1)[1] for line in text.replace("\r", "").split("\n") if line.startswith("WARC-Refers-To:")}
    assert len(refers) == 2 and refers <= {x.split(": ", 1)[1] for x in ids}


def test_small_payloads_are_all_responses(spark):
    rows = warc.read(spark, written(spark, least_bytes=5)).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def test_no_pages(spark):
    assert warc.read(spark, written(spark, [])).count() == 0


def archive(spark, *records):
    path = fresh_path(spark, "warc-test")
    spark.createDataFrame([(f"{warc.VERSION}\r\n{r}\r\n",) for r in records], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path)
    return {r["page_id"]: (r["payload"] and bytes(r["payload"]), r["error"]) for r in warc.read(spark, path).collect()}


def test_foreign_archives(spark, tmp_path):
    """Records of version 1.0, blocks that hold marks, and a length that takes in the next record."""
    http = "HTTP/1.1 200 OK\r\n\r\n"
    inner = f"WARC/1.0\r\n{record(99, http + 'inner')}\r\n\r\n"
    blocks = {1: http + "plain", 2: http + "x\r\n\r\n" + inner, 3: http + ("\r\n\r\nWARC/" * 300), 4: http, 5: http + "\r\n\r\nWARC/1.1", 6: http + "end"}
    for name, version in (("a.warc", "1.0"), ("b.warc", "1.1")):
        text = "".join(f"WARC/{version}\r\n{record(i, b)}\r\n\r\n" for i, b in blocks.items())
        (tmp_path / name).write_bytes(text.encode())
    with gzip.open(tmp_path / "c.warc.gz", "wb") as f:
        f.write(b"".join(f"WARC/1.0\r\n{r}\r\n\r\n".encode() for r in (record(11, http + "a"), record(12, http + "b", length=500), record(13, http + "c"), record(14, "x", length=10**12), record(15, http + "d")))[:-4])
    got = [(r["page_id"], None if r["payload"] is None else bytes(r["payload"]).decode(), bool(r["error"])) for r in warc.read(spark, str(tmp_path)).collect()]
    want = 2 * [(i, b.partition("\r\n\r\n")[2], False) for i, b in blocks.items()]
    want += [(11, "a", False), (12, None, True), (13, "c", False), (14, None, True), (15, "d", False)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def record(page, block, kind="response", more="", length=None):
    return f"WARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{page}>\r\nX-Page-ID: {page}\r\n{more}Content-Length: {len(block) if length is None else length}\r\n\r\n{block}"


def test_broken_archives_are_reported(spark):
    plain, framed = "HTTP/1.1 200 OK\r\n\r\nhello", "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=y\r\nhello\r\n0\r\n\r\n"
    seg = lambda n, total=None: f"WARC-Segment-Number: {n}\r\n" + (f"WARC-Segment-Total-Length: {total}\r\n" if total else "")
    rest = lambda origin, n, block, total=None: record(0, block, "continuation", f"WARC-Segment-Origin-ID: <urn:x:{origin}>\r\n" + seg(n, total))
    got = archive(
        spark, record(1, plain), record(2, framed), record(3, plain, length=7), record(4, framed[:-20]),
        record(5, plain[:20], more=seg(1)), rest(5, 2, plain[20:], len(plain)), record(6, plain[:20], more=seg(1)), rest(6, 3, plain[20:], len(plain)), record(7, plain[:20], more=seg(1)), rest(7, 2, plain[20:], len(plain) + 1), record(8, "x", "warcinfo"),
    )
    assert got[1] == got[2] == got[5] == (b"hello", None)
    assert all(got[i][0] is None and got[i][1] for i in (3, 4, 6, 7)) and 8 not in got


def test_chunks():
    for n in (0, 1, 7, 8, 9, 1000):
        p = bytes(range(256)) * 5
        assert warc.dechunked(warc.chunked(p[:n], 8)) == p[:n]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nhelloX")
