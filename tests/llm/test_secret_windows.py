"""Secrets deep in long runs, beside what a rule matches, and in training."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import secrets

KEY = "ghp_" + hashlib.md5(b"7").hexdigest().upper()
ROUTE = "path/to/some/very/long/route/of/the/service/v2/"


def test_windows_cover_and_short_candidates_stay():
    for n in (12, 44, 45, 66, 67, 300):
        got = secrets.windows(5, 5 + n)
        assert set().union(*(range(*w) for w in got)) == set(range(5, 5 + n)) and max(e - s for s, e in got) <= secrets.INSIDE
        assert all(any(s <= k and k + 22 <= e for s, e in got) for k in range(5, 5 + n - 21))
    assert secrets.windows(3, 40) == [(3, 40)]


def test_parts_beside_a_rule_are_left():
    text = f"{'deadbeef' * 3}-{KEY} plain words"
    assert secrets.base_spans(text) == [(0, 2, 24)]
    left = secrets.uncovered(text, secrets.candidates(text), secrets.base_spans(text))
    assert [text[s:e] for s, e in left] == ["-" + KEY]


def test_parts_left_equal_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1-Z ") + ["deadbeef" * 3, " token=abc123-x/9", "AKIA" + "A1" * 9], 30))
        base, want = secrets.base_spans(text), []
        for s, e in secrets.candidates(text):
            free = [i for i in range(s, e) if not any(a <= i < b for a, _, b in base)]
            runs = [r for r in "".join(chr(1) if i in free else "\0" for i in range(s, e)).split("\0") if r]
            at = s
            for r in runs:
                while at not in free:
                    at += 1
                if (at, at + len(r)) == (s, e) or secrets.CANDIDATE.fullmatch(text[at : at + len(r)]):
                    want.append((at, at + len(r)))
                at += len(r)
        assert secrets.uncovered(text, secrets.candidates(text), base) == want


def test_many_secrets_take_linear_time():
    net = secrets.fit([])
    text = "token=abcdef1234567890 " * 20_000
    start = time.process_time()
    assert len(secrets._spans(net, text)) == 20_000
    assert time.process_time() - start < 30


def test_unknown_keys_are_no_negatives():
    assert secrets.findings(f"see {KEY} it") == []
    assert [n for _, n, _ in secrets.findings("see chapter-alpha-verse-12 x")] == [0]
    assert [n for _, n, _ in secrets.findings("token=abcdef1234567890")] == [1]
    assert [(n, v[secrets.BEFORE : -secrets.AFTER].rstrip(b"\0")) for v, n, _ in secrets.findings("one two three four five")][0][0] == 0


def test_held_out_findings_and_a_key_that_no_rule_knows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = secrets.train(docs)
    assert net.held_out["recall"] >= 0.9 and net.held_out["precision"] >= 0.9 and net.held_out["secrets"] >= 50
    plain = docs.where("length(text) < 3000").limit(20).select("doc_id", F.concat("text", F.lit(f" then {KEY} was sent")).alias("text"))
    for r in secrets.scan(plain, net).collect():
        assert secrets.base_spans(r.text[-50:]) == []
        spans = [(s.kind, r.text[s.start : s.end]) for s in r.secret_spans]
        assert ("model", KEY) in spans and all(s.score is None or 0 <= s.score <= 1 for s in r.secret_spans)


def test_key_after_a_long_route_is_found_and_redacted(spark, sf_dir):
    net = secrets.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = spark.createDataFrame([(1, f"go to {ROUTE}{KEY} now"), (2, f"{'deadbeef' * 3}-{KEY} now")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.redact(secrets.scan(rows, net)).collect()}
    assert all(KEY not in r.text for r in got.values())
    assert [s.kind for s in got[1].secret_spans] == ["model"] and [s.kind for s in got[2].secret_spans] == ["hex", "model"]


def test_all_findings_count_however_many(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    rows = [(10_000 + i, f"alpha beta gamma delta number {i} token={key(i)} and name-of-part-{i} end") for i in range(7_000)]
    frame = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {x for r in frame.where("text IS NOT NULL").collect() for x in secrets.findings(r.text)}
    secret = [x for x in found if x[1]]
    assert len(secret) >= 7_000
    held = sum(x[2] % secrets.SPLITS == 1 for x in [*secret, *secrets._bare(secret)])
    monkeypatch.setattr(secrets, "EPOCHS", 4)
    net = secrets.train(frame)
    assert net.held_out["secrets"] >= held and net.held_out["recall"] >= 0.9 and net.held_out["precision"] >= 0.9
    again = secrets.train(frame.repartition(3))
    assert again.threshold == net.threshold and (again.conv == net.conv).all() and again.held_out == net.held_out
