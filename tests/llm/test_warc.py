import gzip
import hashlib
from pathlib import Path

from cityweave.llm import warc


def brute(rows):
    best = {}
    for k, (i, _, h) in enumerate(rows):
        b = (h or "").encode()
        if len(b) >= 1000 and (b not in best or (i is not None and (rows[best[b]][0] is None or i > rows[best[b]][0]))):
            best[b] = k
    out = []
    for k, (i, _, h) in enumerate(rows):
        b = (h or "").encode()
        again = len(b) >= 1000 and best[b] != k
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", rows[best[b]][0] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big, tricky = "<p>é</p>" * 200, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (2, "u\r\nX: y", tricky), (4, "u", tricky), (6, "u", "small"), (7, "u", "small"), (8, "u", None), (9, "u", ""), (6, "u", "small"), (10, "v", "z" * 2000), (10, "v", "z" * 2000), (None, "n", "q" * 1500), (None, "n", "q" * 1500), (11, "w", "\n" * 1000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    records = [r for f in Path(tmp_path, "w").rglob("*.gz") for r in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len(records) == len(rows)
    assert all("Content-Length" in f for f, _ in records)


def test_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e").count() == 0


def test_repeated_rows_ties_and_long_payloads(spark, tmp_path):
    long = "<p>é\r\n\r\n</p>" * 150_000
    rows = [(5, "u", "y" * 1200)] * 300 + [(5, "v", "y" * 1200)] * 2 + [(1, "u", long), (2, None, long), (None, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string").repartition(5)
    got = warc.round_trip(pages, f"file://{tmp_path}/t").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
