import random
from datetime import datetime, timedelta

from qaloom.llm import revisits

NOON = datetime(2024, 5, 1, 12)
SCHEMA = ("record_id string, warc_type string, profile string, status int, at timestamp, url string, headers map<string,string>,"
          " digest string, key string, found string, part string")


def record(spark_id, kind, minute, url, headers=None, digest=None, status=None):
    status = status or (200 if kind == "response" else 304)
    at = None if minute is None else NOON + timedelta(minutes=minute)
    return (spark_id, kind, None, status, at, url, headers or {}, digest, "k", "f", "p")


def resolved(spark, records):
    return {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()}


def test_canonical_urls(spark):
    same = ["http://Example.com/a/?b=2&a=1#top", "https://example.com:443/a?a=1&utm_source=x&b=2", "http://u:p@EXAMPLE.com:80/a//?&a=1&b=2"]
    other = ["http://example.com/A?a=1&b=2", "http://example.com/a?a=1", "", None, "http://example.com", "http://example.com/"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(revisits.canonical_url(revisits.F.col("u")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got == ["example.com/a?a=1&b=2"] * 3 + ["example.com/A?a=1&b=2", "example.com/a?a=1", "", None, "example.com", "example.com"]


def test_outcomes_and_merged_headers(spark):
    url, tag = "http://x.org/p", {"etag": '"1"', "content-type": "text/html", "cache-control": "max-age=1"}
    got = resolved(spark, [
        record("r1", "response", 0, url, tag, "d1"), record("r2", "response", 10, url, {"etag": '"2"', "last-modified": "L"}, "d2"),
        record("bad", "response", 11, url, tag, status=404), record("v0", "revisit", 0, url, tag),
        record("v1", "revisit", 5, "https://x.org/p#f", {"etag": 'W/"1"', "cache-control": "no-store", "content-type": "x", "connection": "close"}),
        record("v2", "revisit", 20, url, {"etag": '"1"'}), record("v3", "revisit", 20, url, {"last-modified": "L"}),
        record("v4", "revisit", 20, url, {"last-modified": "M"}), record("v5", "revisit", 20, url, {}), record("v6", "revisit", None, url, tag),
        record("v7", "revisit", 20, None, tag), record("v8", "revisit", 20, url, {"etag": '"2"'}, "other"), record(None, "revisit", 20, url, tag),
        record("v1", "revisit", 5, "https://x.org/p#f", {"etag": 'W/"1"', "cache-control": "no-store", "content-type": "x", "connection": "close"}),
    ])
    assert {i: (r.outcome, r.response_id) for i, r in got.items()} == {
        "v0": ("no_response", None), "v1": ("resolved", "r1"), "v2": ("mismatch", "r2"), "v3": ("resolved", "r2"), "v4": ("mismatch", "r2"),
        "v5": ("unvalidated", "r2"), "v6": ("unreadable", None), "v7": ("unreadable", None), "v8": ("mismatch", "r2")}
    assert got["v1"].headers == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "no-store"} and got["v1"].digest == "d1"
    assert got["v2"].headers is None
    assert resolved(spark, []) == {}


def test_as_of_join_is_that_of_brute_force_with_a_hot_url(spark):
    rng = random.Random(8)
    records = []
    for k in range(900):
        url = "http://hot.org/" if rng.random() < 0.6 else f"http://h.org/{rng.randrange(20)}"
        kind = "response" if rng.random() < 0.3 else "revisit"
        records.append(record(f"{k:04d}", kind, rng.randrange(200), url))
    got = resolved(spark, records)
    for r in records:
        if r[1] == "revisit":
            before = [(s[4], s[0]) for s in records if s[1] == "response" and s[5] == r[5] and s[4] < r[4]]
            assert got[r[0]].response_id == (max(before)[1] if before else None)


def test_heads_are_read(spark):
    head = ("WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: http://x.org/a:b\r\nWARC-Date: 2024-05-01T12:00:00Z\r\n"
            "\r\nHTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\netag: \"b\"\r\nVary:  Accept \r\nno field\r\n")
    df = spark.createDataFrame([(head, 1), (None, 2), ("", 3), ("junk\n\nmore", 4)], "head string, url int")
    got = revisits.parse_heads(df).collect()
    assert (got[0].warc_type, got[0].record_id, got[0].url, got[0].status) == ("revisit", "<urn:1>", "http://x.org/a:b", 304)
    assert got[0].headers == {"etag": '"a"', "vary": "Accept"} and got[0]["at"] == NOON
    assert all(r.status is None and r.headers == {} and r.record_id is None for r in got[1:])
