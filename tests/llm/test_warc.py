import glob
import gzip
import os
import random

from pyspark.sql import functions as F

from textloom.llm import warc
from textloom.llm.common import scratch

from .conftest import same


def brute_base(rows):
    out = []
    for i, key, ts, kind in rows:
        if kind == "revisit" and key is not None and ts is not None:
            place = (ts, i if i is not None else float("-inf"))
            earlier = [(t, j) for j, k, t, x in rows if x == "response" and k == key and t is not None and j is not None and (t, j) < place]
            out.append((i, key, ts, max(earlier)[1] if earlier else None))
    return out


def test_as_of_join_in_chunks(spark):
    rng = random.Random(3)
    rows = [(i if rng.random() < 0.97 else None, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([rng.randint(0, 300), 150, None]), rng.choice(["response", "revisit", "revisit"])) for i in range(600)]
    frame = spark.createDataFrame(rows, "record_id bigint, key string, ts bigint, kind string")
    for chunk_rows in (1_000_000, 25):
        same(warc.latest_responses(frame, chunk_rows), brute_base(rows))


def test_canonical_urls(spark):
    rows = [
        ("HTTPS://WWW.Example.com:443/a/b.html#top", "example.com/a/b.html"), ("http://m.example.com/a/b/", "m.example.com/a/b/"), ("https://example.com/a/b?utm_source=feed", "example.com/a/b"),
        ("https://example.com/x?page=2&ref=x", "example.com/x?page=2"), ("https://example.com/x?ref=x&page=2", "example.com/x?page=2"), ("http://example.com/", "example.com"), ("http://example.com", "example.com"), ("", ""), (None, None),
    ]
    got = spark.createDataFrame(rows, "url string, want string").select(warc.canonical_url(F.col("url")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_other_resources_are_no_base(spark):
    rows = [(1, "http://a.de/x.html", 1, "response", {}, b"page"), (2, "http://a.de/x", 2, "revisit", {}, None), (3, "http://m.a.de/x.html", 3, "revisit", {}, None), (4, "https://www.a.de:443/x.html#y", 4, "revisit", {}, None)]
    got = {r.record_id: r.status for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {2: "orphan", 3: "orphan", 4: "unverified"}


def test_chunks_are_even_where_times_are_not(spark):
    rows = [(i, "u", i % 500, "response") for i in range(1000)] + [(1001, "u", 10**12, "revisit"), (1002, "v", -(10**9), "revisit")]
    frame = spark.createDataFrame(rows, "record_id bigint, key string, ts bigint, kind string")
    sizes = [r["count"] for r in warc.chunked(frame, 100).groupBy("chunk").count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 210
    same(warc.latest_responses(frame, 100), brute_base(rows))


def test_what_a_revisit_refers_to(spark):
    rows = [
        (1, "http://a.de/x", 10, "response", {}, b"old", None, None), (2, "http://a.de/x", 20, "response", {}, b"new", None, None), (3, "http://a.de/x", 30, "revisit", {}, None, "http://a.de/x", 10),
        (4, "http://a.de/x", 30, "revisit", {}, None, None, None), (5, "http://b.de/", 30, "revisit", {}, None, "http://a.de/x", None), (0, "http://a.de/x", 30, "revisit", {}, None, "http://a.de/x", 20), (6, "http://a.de/x", 15, "revisit", {}, None, "http://a.de/x", 99),
    ]
    frame = spark.createDataFrame(rows, warc.RECORD + ", refers_to_url string, refers_to_ts bigint")
    got = {r.record_id: (r.url, r.ts, bytes(r.body)) for r in warc.resolve_revisits(frame).collect()}
    assert got == {3: ("a.de/x", 30, b"old"), 4: ("a.de/x", 30, b"new"), 5: ("b.de", 30, b"new"), 0: ("a.de/x", 30, b"new"), 6: ("a.de/x", 15, b"old")}


def test_long_bodies_and_clashing_columns(spark):
    body = bytes(range(256)) * 20_000
    rows = [(1, "http://a.de/x", 1, "response", {"etag": "1"}, body, 1, "s"), (2, "http://a.de/x", 2, "revisit", {"etag": "1"}, None, 1, "s"), (2, "http://a.de/x", 2, "revisit", {"etag": "1"}, None, 2, "t")]
    frame = spark.createDataFrame(rows, warc.RECORD + ", base_id int, status string")
    got = warc.resolve_revisits(frame).collect()
    assert [(r.base_id, r.status, bytes(r.body) == body) for r in got] == [(1, "resolved", True)] * 2


def test_bodies_are_written_with_the_denser_codec(spark):
    rng = random.Random(4)
    page = lambda: "<p>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(4000))
    rows = [(2 * i + k, f"http://a.de/{i}", k, ("response", "revisit")[k], {}, None if k else page().encode()) for i in range(40) for k in (0, 1)]
    with scratch(spark):
        got = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()
        base = max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/bases-*"), key=os.path.getmtime)
        names = glob.glob(f"{base}/*.parquet")
    assert {(r.record_id - 1, bytes(r.body)) for r in got} == {(r[0], r[5]) for r in rows if r[5]}
    assert names and all(n.endswith(".zstd.parquet") for n in names)


def records(spark):
    rows = [
        (1, "http://a.de/x", 10, "response", {"ETag": '"1"', "Content-Type": "text/html", "Date": "d1"}, b"one"),
        (2, "https://www.a.de/x", 20, "revisit", {"etag": 'W/"1"', "date": "d2", "content-type": "no"}, None),
        (3, "http://a.de/x", 30, "revisit", {"etag": '"2"'}, None),
        (4, "http://a.de/x", 40, "revisit", None, None),
        (5, "http://b.de/", 5, "revisit", {}, None),
        (6, "http://b.de/", 6, "response", {"Last-Modified": "lm"}, b"two"),
        (7, "http://b.de", 7, "revisit", {"Last-Modified": "lm", "ETAG": "x", "etag": "y"}, None),
        (8, None, 8, "revisit", {}, None), (9, "http://b.de", None, "revisit", {}, None), (7, "http://b.de", 7, "revisit", {"Last-Modified": "lm", "ETAG": "x", "etag": "y"}, None),
    ]
    return spark.createDataFrame(rows, warc.RECORD)


def test_statuses_and_headers(spark):
    got = warc.resolve_revisits(records(spark)).collect()
    assert len(got) == 8
    own = {r.record_id: r for r in got}
    assert (own[2].status, own[2].base_id, own[2].body) == ("resolved", 1, b"one")
    assert own[2].headers == {"etag": 'W/"1"', "content-type": "text/html", "date": "d2"}
    assert (own[3].status, own[3].body) == ("mismatch", None)
    assert (own[4].status, own[4].body) == ("unverified", b"one")
    assert own[5].status == "orphan" and own[8].status == "orphan" and own[9].status == "orphan"
    assert own[7].status == "resolved" and own[7].base_id == 6


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_files(spark, tmp_path):
    one = warc.format_record({"WARC-Type": "response", "WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://a.de/", "WARC-Date": "2024-01-01T00:00:00Z"}, {"ETag": "1"}, b"body\r\n\r\n\xff\x00more")
    two = warc.format_record({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:2>", "WARC-Target-URI": "http://a.de", "WARC-Date": "2024-01-02T00:00:00Z"}, {"ETag": "1"}, b"")
    (tmp_path / "a.warc").write_bytes(one + b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one)[:40])
    got = warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()
    assert [(r.status, r.body) for r in got] == [("resolved", b"body\r\n\r\n\xff\x00more")]
