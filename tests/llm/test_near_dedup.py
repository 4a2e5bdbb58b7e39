"""Near duplicates by word shingles: against brute force, and in the pipeline's stage."""

import numpy as np

import corpus_pipeline as pipeline
from tidelog.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """Component id of each row place, by all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {i: least[find(i)] for i in range(len(rows))}


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(10**6)}"
    return out


def corpus():
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 500, n)]
    line, texts = word(12), ["", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = word(int(rng.integers(30, 150))) + line
        texts += [" ".join(edited(rng, base, int(n))) for n in rng.integers(0, 4, 5)]
    chain = word(100)
    for _ in range(8):  # neighbours are alike, the ends are not
        chain = edited(rng, chain, 1)
        texts.append(" ".join(chain))
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    assert len(set(want.values())) < len(rows) - 20
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(frame).collect()} == want
    monkeypatch.setattr(shingles, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(shingles, "COMMON", 1)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(frame).collect()} == want
    assert shingles.near_duplicates(frame.where("false")).count() == 0


def test_stage_drops_near_copies_of_more_than_two_bits(spark, sf_dir):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    near = " ".join(edited(rng, base, 2))
    bits = simhash.fingerprint(" ".join(base).encode()) ^ simhash.fingerprint(near.encode())
    assert (bits % (1 << 64)).bit_count() > 2
    far = " ".join(edited(rng, base, 12))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([" ".join(base), near, far])]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]


def test_rows_of_one_id_are_told_apart(spark, sf_dir):
    a, b = [f"a{i}" for i in range(60)], " ".join(f"b{i}" for i in range(60))
    near = " ".join([*a[:-1], "z"])
    pairs = [(5, " ".join(a)), (5, b), (5, b), (3, near), (None, b)]
    rows = [(i, t, "en", "s", len(t)) for i, t in pairs]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, b), (3, near), (5, b)])
