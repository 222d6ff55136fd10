"""The wire format against its public bindings' rules, and the polling source over restarts."""

import random
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from cityweave.sources import feeds

ROWS = [("e1", "bus 1", "t", "r", 1.5, -2.25, 90.0, 3.5, 1_700_000_000), ("e2", None, None, None, 5.0, 0.0, None, None, None), ("e3", "null island", "t", "r", 0.0, 0.0, 1.0, 1.0, 5), ("e4", "no place", "t", None, None, None, None, None, 5), (None, None, None, "é", -1.0, 0.5, None, 0.0, 2**40)]
WANT = [("bus 1", "t", "r", 1.5, -2.25, 90.0, 3.5, 1_700_000_000), ("e2", None, None, 5.0, 0.0, None, None, None), ("?", None, "é", -1.0, 0.5, None, 0.0, 2**40)]


def test_positions_and_unknown_fields():
    assert feeds.vehicle_positions(feeds.encode(ROWS)) == WANT
    odd = feeds._tagged(99, 2**63) + feeds._tagged(1000, "later") + bytes([(77 << 3 & 127) | 1 | 128, 77 >> 4]) + struct.pack("<d", 1.0)
    assert feeds.vehicle_positions(odd + feeds.encode(ROWS) + odd) == WANT
    place = lambda *f: feeds._tagged(2, feeds._tagged(4, b"".join(f)))
    twice = place(feeds._tagged(2, feeds._tagged(1, 1.0)), feeds._tagged(2, feeds._tagged(2, 2.0)))  # merged
    assert [r[3:5] for r in feeds.vehicle_positions(twice)] == [(1.0, 2.0)]
    assert feeds.vehicle_positions(None) == feeds.vehicle_positions(b"") == feeds.vehicle_positions(feeds.encode([])) == []


def test_cut_and_broken_messages_have_no_rows():
    whole = feeds.encode(ROWS)
    r = random.Random(1)
    for k in range(len(whole)):
        assert feeds.vehicle_positions(whole[:k]) in ([], WANT[:1], WANT[:2])  # a cut between entities is a whole message
        broken = bytearray(whole)
        broken[k] = r.randrange(256)
        feeds.vehicle_positions(bytes(broken))  # never raises
    assert feeds.vehicle_positions(b"\x0b" + whole) == []  # a group


def test_decoded_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, feeds.encode(ROWS), "x"), (2, None, "y"), (3, b"\xff", "z")], "poll long, payload binary, place string")
    assert [tuple(r) for r in feeds.decoded(df).collect()] == [(1, "x", *w) for w in WANT]


@pytest.fixture
def server():
    class Answer(BaseHTTPRequestHandler):
        payload, asked = b"", []

        def do_GET(self):
            Answer.asked.append((self.path, self.headers.get("Authorization"), self.headers.get("api_key")))
            self.send_response(200 if Answer.payload else 503)
            self.end_headers()
            self.wfile.write(Answer.payload)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield Answer, f"http://127.0.0.1:{http.server_port}/feed"
    http.shutdown()


def test_fetch_keys_and_failures(server):
    answer, url = server
    assert feeds.fetch(url) is None and feeds.fetch("") is None and feeds.fetch("http://127.0.0.1:1/") is None
    answer.payload = b"x"
    assert feeds.fetch(url, "k") == b"x" and answer.asked[-1] == ("/feed", "k", "k")
    assert feeds.fetch(url, "k", "key") == b"x" and answer.asked[-1] == ("/feed?key=k", None, None)
    assert feeds.fetch(url + "?a=1", "k", "key") == b"x" and answer.asked[-1][0] == "/feed?a=1&key=k"


def test_reader_replays_what_it_logged(server, tmp_path):
    answer, url = server
    options = {"url": url, "log": f"file://{tmp_path}/log"}
    reader = feeds.FeedReader(options)
    assert list(reader.read({"poll": 0})[0]) == []  # the server fails
    answer.payload = feeds.encode(ROWS[:1])
    rows, end = reader.read({"poll": 0})
    assert [r[:2] for r in rows] == [(0, "bus 1")] and end == {"poll": 1}
    answer.payload = feeds.encode(ROWS)  # the feed has moved on: a restart still reads what was logged
    again = feeds.FeedReader(options)
    assert len(list(again.readBetweenOffsets({"poll": 0}, {"poll": 1}))) == 1
    assert len(list(again.read({"poll": 0})[0])) == 1
    rows, end = again.read(end)
    assert len(list(rows)) == 3 and end == {"poll": 2}
    rows, same = again.read(end)  # the same payload again: no news
    assert list(rows) == [] and same == end
    answer.payload = feeds.encode([])
    assert again.read(end)[1] == end
    again.commit(end)
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["1.pb"]


def test_stream_stopped_between_polls_gives_each_row_once(spark, server, tmp_path):
    answer, url = server
    spark.dataSource.register(feeds.VehicleFeed)
    out, point = str(tmp_path / "out"), str(tmp_path / "point")

    def run():
        s = spark.readStream.format("vehicle_feed").options(url=url, log=f"file://{tmp_path}/log").load()
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(processingTime="100 milliseconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    answer.payload = feeds.encode(ROWS)
    run()
    answer.payload = feeds.encode(ROWS[:1])
    run()
    run()  # nothing new
    answer.payload = feeds.encode(ROWS[1:2])
    run()
    got = sorted((r.poll, r.vehicle_id) for r in spark.read.schema(f"poll bigint, {feeds.COLUMNS}").parquet(out).collect())
    assert got == [(0, "?"), (0, "bus 1"), (0, "e2"), (1, "bus 1"), (2, "e2")]
