"""WARC round trips against the payloads themselves."""

import base64
import glob
import hashlib

from pyspark.sql import functions as F

from babelgrid.llm import warc

SCHEMA = "page_id long, url string, html string, record_type int"


def plain(rows, min_bytes=0):
    best = {}
    for page, _, html, *_ in rows:
        h = html or ""
        if page is not None and len(h.encode()) >= min_bytes:
            best[h] = max(page, best.get(h, page))
    count = {}
    for _, _, html, *_ in rows:
        count[html or ""] = count.get(html or "", 0) + 1
    out = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        to = best.get(html or "")
        again = to is not None and count[html or ""] > 1 and page != to
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>one</p>", 0), (2, "http://a/2", "<p>one</p>", 0), (3, None, None, 0),
        (4, "http://b\r\nWARC-Type: x", "", 0), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", 0),
        (2 ** 62 + 1, "u", "é€𝄞" * 50_000, 0), (7, "u", "\r\n\r\n", 0), (None, "u", "<p>one</p>", 0),
        (None, "u", "alone", 0), (None, "u", "alone", 0), (9, "u", "same", 0), (9, "u", "same", 0), (8, "u", "same", 0)]


def read_back(spark, rows, **how):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    files = warc.write_archives(warc.plan_records(pages, min_bytes=how.get("min_bytes", 0)),
                                chunk=how.get("chunk", 1000), file_bytes=how.get("file_bytes", 1 << 20))
    return files, sorted((tuple(r) for r in warc.page_records(files, how.get("chunk", 1000)).collect()), key=str)


def test_round_trip(spark):
    assert read_back(spark, ROWS)[1] == plain(ROWS)


def test_small_payloads_are_all_responses(spark):
    assert read_back(spark, ROWS, min_bytes=5)[1] == plain(ROWS, 5)


def test_files_roll_over(spark):
    files, got = read_back(spark, ROWS, file_bytes=1)
    assert files.count() == len(ROWS) and got == plain(ROWS)


def test_empty(spark):
    files, got = read_back(spark, [])
    assert got == [] and files.count() == 0


def test_chunks_carry_the_payload_and_its_running_digest(spark):
    files, _ = read_back(spark, ROWS)
    rows = warc.read_chunks(files, 777).orderBy("path", "offset", "chunk").collect()
    payloads, seen = {}, {}
    for r in rows:
        assert len(r.data) == r.chunk_bytes <= 777
        key = (r.path, r.offset)
        assert r.chunk == seen.get(key, -1) + 1
        seen[key] = r.chunk
        payloads[key] = payloads.get(key, b"") + bytes(r.data)
        assert r.total_bytes == len(payloads[key])
        assert r.running_digest == base64.b32encode(hashlib.sha1(payloads[key]).digest()).decode()
    texts = sorted(p for k, p in payloads.items())
    held = {(h or "").encode() for _, _, h, _ in ROWS}
    assert set(texts) == held


def test_a_damaged_archive_fails(spark):
    files, _ = read_back(spark, [(1, "u", "payload " * 100, 0)])
    path = files.first().path
    for name in glob.glob(path.removeprefix("file:")):
        raw = open(name, "rb").read()
        open(name, "wb").write(raw.replace(b"payload payload", b"payl0ad payload", 1))
    try:
        warc.page_records(files).select(F.max("payload_digest")).collect()
    except Exception as e:
        assert "differs from its digest" in str(e)
    else:
        raise AssertionError("damage went unseen")
