"""Importance resampling against brute force, with nulls, copies, empty texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

from tidelog.llm import queries, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text):
    w = words(text)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, bench):
    have, want = Counter(g for _, t in rows for g in grams(t)), Counter(g for t in bench for g in grams(t))
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000))))
    out = []
    for i, text in rows:
        got = grams(text)
        weight = sum(map(gain, got)) // len(got) if got else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(enough[: 25 * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long = " ".join(f"Wörd{i}x, b{i % 7}" for i in range(400_000))
    rows = docs + [(9001, None), (9002, ""), (None, docs[3][1]), (9003, "A-b_c 12é"), (9004, long)] + [(9100 + i, docs[5][1]) for i in range(60)] + [docs[7], docs[7]]
    frame = spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], "doc_id long, text string, n long, key string, weight int, rank string")
    target = spark.createDataFrame([(t,) for t in [*bench, None, ""]], "text string")
    got = sorted((tuple(r) for r in resample.resample(frame, target, 25, 7).collect()), key=str)
    assert got == brute(rows, bench)
    assert resample.resample(frame.where("false"), target, 25, 7).count() == 0
    none = resample.resample(frame.limit(50), target.where("false"), 25, 7).collect()
    assert len(none) == 50


def test_a_long_text_in_parts_has_the_same_features(monkeypatch):
    text = ("Ab1 " + "x" * 50 + " é-é,," + "z " * 7).encode() * 9
    whole = resample.buckets(text)
    for size in (1, 3, 7, 20, 64):
        monkeypatch.setattr(resample, "TEXT_BYTES", size)
        n, got = resample.buckets(text)
        assert n == whole[0] and sorted(got.tolist()) == sorted(whole[1].tolist()), size
    assert resample.buckets(b"")[0] == 0


def test_query(spark, sf_dir):
    df = queries.op11_target_resampling(spark, sf_dir)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
