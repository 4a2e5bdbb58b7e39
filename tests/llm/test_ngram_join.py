"""The universe-partition join: no similar pair without a common signature, and components against brute force."""

import numpy as np
import pytest

from test_near_dedup import corpus, groups, shingle_set
from tidelog.llm import partition, queries, shingles


def similar(rng, n, similarity):
    """A set of about ``n`` hashes and another that is just similar to it, or more than that."""
    a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    n = len(a)
    kept = rng.permutation(a)[: n - int(rng.integers(0, n * (similarity.whole - similarity.part) // similarity.whole + 1))]
    room = len(kept) * similarity.whole // similarity.part - n
    new = rng.integers(0, 1 << 63, max(0, room - int(rng.integers(0, 3)))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return np.sort(a), np.unique(np.concatenate([kept, new]))


@pytest.mark.parametrize("part, whole", [(4, 5), (9, 10), (1, 2)])
def test_similar_sets_share_a_signature(part, whole):
    rng, measure = np.random.default_rng(2), partition.Similarity(part, whole)
    for trial in range(600):
        a, b = similar(rng, int(rng.choice([1, 2, 3, 5, 8, 13, 30, 60, 127, 200, 400])) + int(rng.integers(0, 3)), measure)
        both = len(np.intersect1d(a, b))
        assert both * whole >= part * (len(a) + len(b) - both)
        counts = [(rng.random(len(x)) < 0.5) * rng.integers(0, 50, len(x)) if trial % 2 else None for x in (a, b)]
        (h, r), (k, q) = (partition.signatures(x, measure, c) for x, c in zip((a, b), counts))
        find = lambda keys, roles, role: set(keys[roles & role > 0].tolist())
        assert find(h, r, partition.LOOKS) & find(k, q, partition.FOUND) or find(k, q, partition.LOOKS) & find(h, r, partition.FOUND)


def test_budgets_add_up():
    rng = np.random.default_rng(4)
    for _ in range(500):
        n = int(rng.integers(1, 80))
        need, flexible = int(rng.integers(1, n + 1)), int(rng.integers(0, n // 8 + 1))
        size = rng.integers(0, 6, n)
        cost = np.where(size == 0, partition.EMPTY, rng.integers(0, 40, n))
        v = partition.budgets(need, size, cost, rng.integers(0, 60, n), flexible)
        assert v.sum() == need and v.min() >= 0 and v.max() <= 2 and not (v[flexible:] == 2).any() and not (size[v == 2] < 2).any()


def test_rows_that_come_in_many_batches_meet(monkeypatch):
    monkeypatch.setattr(partition, "GATHERED", 5)
    rng = np.random.default_rng(6)
    h = np.sort(rng.integers(0, 12, 300))
    looks = rng.random(300) < 0.1
    who = (np.arange(300) << partition.ROLE_BITS) | partition.FOUND | np.where(looks, partition.LOOKS, 0)
    who[looks] |= partition.FIRST
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(h[i : i + 7]), pa.array(who[i : i + 7])], ["h", "who"]) for i in range(0, 300, 7)]
    got = {(x, n) for b in partition._with_company(iter(batches)) for x, n in zip(b.column("h").to_pylist(), b.column("node").to_pylist())}
    node = partition._node(who)
    assert got == {(int(x), int(n)) for x, n in zip(h, node) if (who[h == x] < 0).any() and (h == x).sum() > 1}


def test_components_equal_brute_force(spark, monkeypatch):
    rows = corpus() + [(900, None), (901, " "), (902, "a b c d e"), (903, "x " * 9), (904, "x " * 12), (2, "one two")]
    common = [f"c{i}" for i in range(40)]
    rows += [(1000 + i, " ".join([*common, *(f"q{i}_{k}" for k in range(12 + i % 4))])) for i in range(30)]  # a passage that many share
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, node int")
    own = [(i, t) for i, t in rows if shingle_set(t)]
    want = groups(own)
    expected = {(own[k][0], len(shingle_set(own[k][1])), c) for k, c in want.items()} | {(i, 0, i) for i, t in rows if not shingle_set(t)}

    def run():
        found = shingles.near_duplicates(frame, fingerprints=False)
        return {(r.doc_id, r.n_shingles, r.doc_id if not r.n_shingles else r.component_id) for r in found.collect()}

    assert run() == expected
    monkeypatch.setattr(shingles, "TILE", 3)
    monkeypatch.setattr(shingles, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(partition, "MANY", 2)
    monkeypatch.setattr(partition, "GATHERED", 50)
    assert run() == expected


def test_pairs_that_share_many_blocks_come_about_once(spark):
    common = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join([*common, *(f"q{i}_{k}" for k in range(60))])) for i in range(12)]  # 0.75 alike: no links, but likely
    texts = shingles._texts(spark.createDataFrame(rows, "doc_id long, text string"))
    none = np.empty(0, np.int64)
    blocks = partition.blocks(texts, shingles.shingle_hashes, partition.Similarity(4, 5), (none, none), 1 << 20)
    mixed = shingles._mixed(blocks, spark.createDataFrame([], "node long, root long"), texts)
    assert mixed.count() > 12 * 20  # each text is in many blocks
    pairs = [tuple(sorted(r[:2])) for r in shingles._compared(mixed).collect()]
    assert len(set(pairs)) == 12 * 11 // 2 and len(pairs) <= 2 * len(set(pairs))


def test_rounds_move_no_more_than_they_need(spark):
    texts = spark.createDataFrame([(i, 3, shingles.sketch(np.arange(3))) for i in range(4)], "node long, n long, sketch binary")
    blocks = spark.createDataFrame([(h, i) for h in (1, 2) for i in range(2 * h - 2, 2 * h)], "h long, node long")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    mixed = shingles._mixed(blocks, roots, texts)
    assert {r["h"] for r in mixed.collect()} == {2}  # a later round begins with these
    assert "least" not in shingles._tiles(mixed, False).columns and "least" in shingles._tiles(mixed, True).columns
    assert [tuple(sorted(r[:2])) for r in shingles._compared(mixed, 1).collect()] == [(2, 3)]


def test_sketches_leave_room_for_what_is_alike():
    rng = np.random.default_rng(5)
    for n in (1, 3, 60, 128, 129, 700, 5_000, 90_000):
        a = np.sort(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
        b = np.sort(np.concatenate([a[n // 10 :], rng.integers(-(1 << 63), 1 << 63, n // 10, dtype=np.int64)]))
        b = b[: max(1, len(b) - n // 200)]
        for x, y in ((shingles.fine(a), shingles.fine(b)), (shingles.sketch(a), shingles.sketch(b)), (shingles.sketch(a), shingles.fine(b))):
            assert shingles.room(x, y, len(a), len(b)) >= shingles.alike(len(np.intersect1d(a, b)), len(a), len(b))
    same = np.arange(0, 128 * 1_000, 128)  # all in one class, more than a byte holds
    for h in (same, same[:255], same[:256], same[:511], same[:512]):
        assert shingles.counts([shingles.sketch(h)])[0, 0] >= len(h) and shingles.room(shingles.sketch(h), shingles.fine(h), len(h), len(h))


def test_query(spark, sf_dir):
    df = queries.op13_ngram_jaccard_join(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
