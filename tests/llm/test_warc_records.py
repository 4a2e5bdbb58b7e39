"""WARC records as crawlers write them: ISO 8601 dates, headers without a space, payloads of revisits."""

import datetime

import numpy as np

from tidelog.llm import queries, warc


def text(kind, name, date, http, payload=""):
    head = f"WARC/1.1\r\nWARC-Type:{kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI:http://a.com/x\r\nWARC-Date: {date}\r\n"
    return f"{head}\r\nHTTP/1.1 200 OK: fine\r\n{http}\r\n\r\n{payload}\r\n\r\n"


def test_real_records_resolve_to_payloads(spark):
    rows = [
        text("response", "r1", "2024-02-29T23:59:58Z", 'ETag:"x"\r\nContent-Type:\ttext/html ', "<p>one</p>"),
        text("response", "r2", "2024-03-01T00:00:00.250Z", 'ETag: "y"', "two\r\n\r\n"),
        text("revisit", "v1", "2024-02-29T23:59:59.5Z", 'ETag:W/"x"'),
        text("revisit", "v2", "2024-03-01T02:00:01+01:00", 'ETag:"y"'),
        text("revisit", "v3", "2024-03-01T00:00:00.000001Z", 'ETag:"z"'),
        text("revisit", "v4", "2024-02", 'ETag:"x"'),
        text("revisit", "v5", "soon", 'ETag:"x"'),
    ]
    records = warc.parse_records(spark.createDataFrame([(r,) for r in rows], "warc string"))
    got = {r.record_id: r for r in warc.with_payload(warc.resolve(records), records).collect()}
    assert {k: (r.status, r.response_id, r.payload) for k, r in got.items()} == {
        "r1": ("full", "r1", "<p>one</p>"),
        "r2": ("full", "r2", "two\r\n\r\n"),
        "v1": ("resolved", "r1", "<p>one</p>"),
        "v2": ("resolved", "r2", "two\r\n\r\n"),
        "v3": ("changed", None, None),
        "v4": ("orphan", None, None),
        "v5": ("orphan", None, None),
    }
    assert got["v1"].headers == {"etag": 'W/"x"', "content-type": "text/html"} and got["v5"].captured is None


def test_dates(spark):
    dates = ["2024", "2024-03", "2024-03-04", "2024-03-04T05:06Z", "2024-03-04T05:06:07", "2024-03-04T05:06:07.123456789Z", "12", "12345", None]
    frame = spark.createDataFrame([(d,) for d in dates], "d string")
    got = [r[0] for r in frame.select(warc.timestamp(frame.d).cast("string")).collect()]
    want = ["2024-01-01 00:00:00", "2024-03-01 00:00:00", "2024-03-04 00:00:00", "2024-03-04 05:06:00", "2024-03-04 05:06:07", "2024-03-04 05:06:07.123456"]
    assert got == [*want, None, None, None] and datetime.datetime.fromisoformat(got[0])


def test_content_length_and_profiles(spark):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {}\r\nWARC-Profile: p\r\nWARC-Refers-To: q\r\n{}\r\n\r\n"
    top, body = "HTTP/1.1 200 OK\r\nA: 1\r\n\r\n", "né\r\n\r\n"
    cut = len((top + body).encode())
    rows = [
        (head.format("a", f"Content-Length: {cut}") + top + body + "\r\n\r\n",),  # the payload ends in a blank line itself
        (head.format("b", f"Content-Length: {cut - 6}") + top + body + "\r\n\r\n",),
        (head.format("c", "Content-Length: x") + top + body + "\r\n\r\n",),
        (head.format("d", "Content-Length: 99999") + top + body + "\r\n\r\n",),
        (head.format("e", f"Content-Length: {cut}") + top + body,),
        (head.format("f", "Content-Length: 0") + top + body,),
    ]
    got = {r.record_id: r for r in warc.parse_records(spark.createDataFrame(rows, "warc string")).collect()}
    assert {k: r.payload for k, r in got.items()} == {"a": body, "b": "n", "c": body, "d": body, "e": body, "f": ""}
    assert {(r.profile, r.refers_to) for r in got.values()} == {("p", "q")}


def test_revisits_of_other_profiles_and_brute_force(spark):
    rng = np.random.default_rng(12)
    profiles = [None, "http://x/revisit/server-not-modified", "http://x/revisit/identical-payload-digest"]
    rows = [
        (
            f"{'vr'[int(k)]}{i}",
            ("revisit", "response")[int(k)],
            None if rng.random() < 0.2 else f"http://h{rng.integers(3)}.com/",
            None if rng.random() < 0.1 else int(rng.integers(0, 60)),
            profiles[int(rng.integers(3))],
            {x: str(rng.integers(2)) for x in ("etag", "last-modified", "vary") if rng.random() < 0.6},
            f"p{i}" if k else None,
            "x" * 10,
        )
        for i, k in enumerate(rng.integers(0, 2, 300))
    ]
    given = spark.createDataFrame(
        rows, "record_id string, kind string, url string, captured long, profile string, headers map<string,string>, payload string, response string"
    )
    want = {}
    for r in rows:
        if r[1] == "response":
            want[r[0]] = ("full", r[0], r[5], r[6])
            continue
        if r[4] == profiles[2]:
            want[r[0]] = ("other_profile", None, r[5], None)
            continue
        before = [x for x in rows if x[1] == "response" and None not in (r[2], r[3], x[2], x[3]) and x[2] == r[2] and x[3] < r[3]]
        if not before:
            want[r[0]] = ("orphan", None, r[5], None)
            continue
        x = max(before, key=lambda y: (y[3], y[0]))
        name = "etag" if "etag" in r[5] else "last-modified"
        if name in r[5] and r[5][name] != x[5].get(name):
            want[r[0]] = ("changed", None, r[5], None)
        else:
            merged = {**x[5], **{k: v for k, v in r[5].items() if k in ("etag", "vary")}}
            want[r[0]] = ("resolved" if name in r[5] else "unverified", x[0], merged, x[6])
    for buckets in (None, 5):
        found = warc.with_payload(warc.resolve(given, buckets), given).collect()
        assert {r.record_id: (r.status, r.response_id, r.headers, r.payload) for r in found} == want and len(found) == len(rows)
    assert len({s for s, *_ in want.values()}) == 6


def test_very_long_record(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "é" * 3_000_000)], "page_id long, url string, html string")
    got = [r for r in warc.parse_records(queries.crawl_records(pages)).collect() if r.kind == "response"]
    assert got[0].payload == "é" * 3_000_000
