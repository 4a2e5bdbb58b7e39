"""The registered queries on the small tables: final columns, and values against brute force or the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import brute_fingerprint, brute_spans

from tidelog.llm import langid, queries, tokenfiles, toxicity


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, sf_dir, name, columns):
    df = queries.queries()[name](spark, sf_dir)
    assert [f"{c}:{t}" for c, t in df.dtypes][: len(columns.split())] == columns.split()
    return df.collect()


crc = lambda i: zlib.crc32(str(i).encode())
sha = lambda x: hashlib.sha256(x).hexdigest()


def test_op3(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op3_language_id", "doc_id:bigint held_out:boolean lang_pred:string score:double")
    assert {r.doc_id for r in rows} == set(texts) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in rows)


def test_language_scores_equal_brute_force(spark, sf_dir, texts):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def word(w):
        w = f" {w} "
        if w in model.known:
            return model.table[model.known[w]]
        for n in (4, 3, 2, 1):
            found = [model.table[model.grams[n - 1][g]] for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g in model.grams[n - 1]]
            if found:
                return np.clip(sum(found) / n, -langid.WORD_LIMIT, langid.WORD_LIMIT)
        return np.zeros(len(model.languages))

    some = [t for t in texts.values() if t and len(t) < 3000][:40] + ["", "Zzzxq unseen wörds hére", "9 !"]
    scorer = langid.Scorer(model)
    for t, (lang, score, margin) in zip(some, scorer.predict(some)):
        split = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        if not split:
            assert (lang, score, margin) == ("und", 0, 0)
            continue
        sums = sum(word(w) for w in split)
        order = np.argsort(sums)
        assert lang == model.languages[order[-1]] and np.isclose(margin, (sums[order[-1]] - sums[order[-2]]) / len(split))
        assert np.isclose(score, 1 / np.exp(sums + model.prior - max(sums + model.prior)).sum())


def test_op4(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op4_secret_scan", "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in brute_spans(texts[r.doc_id] or "")]
        kinds = [b.split(":")[0] for b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(",".join(base).encode())
        assert [x for x in r.spans.split(",") if x and not x.startswith("model")] == base


def test_op5(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op5_token_files", "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint")
    t, start, want = tokenfiles.Tokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer, 0, []
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in rows) == want


def test_op6(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op6_toxicity", "doc_id:bigint held_out:boolean score:double predicted:int")
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_scores_equal_brute_force():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 1.0, 0.0)

    def buckets(raw):
        mask = (1 << 64) - 1
        mixed = lambda h: ((h ^ (h >> 29)) * toxicity._PRIME & mask) >> 48
        power = [pow(toxicity._PRIME, k + 1, 1 << 64) for k in range(max(len(raw), 6))]
        value = lambda x: sum((ord(c) + 1) * power[k] for k, c in enumerate(x)) & mask
        return [mixed(value(raw))] + [mixed(value(raw[i : i + n]) ^ n) for n in range(3, 7) for i in range(len(raw) - n + 1)]

    def brute(text):
        raw = [f"<{w}>" for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        cut = [w[i : i + 40] for w in raw for i in (range(0, max(1, len(w) - 5), 35) if len(w) > 40 else [0])]
        values = [model.odds[buckets(w)].mean() for w in cut]
        blocks = [values[i : i + 8] for i in range(0, len(values), 8)]
        segments = [a + b for a, b in zip(blocks, blocks[1:])] or blocks
        return max((sum(s) / max(len(s), 8) for s in segments), default=0.0)

    words = ["a", "Éa", "straße", "grumble", "x" * 100, "y" * 39, "日本"]
    docs = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 50, 40)] + ["", "12"]
    assert np.allclose(toxicity.Scorer(model).raw(docs), [brute(t) for t in docs])


def test_a_toxic_word_behind_a_long_run_counts():
    rng = np.random.default_rng(2)
    plain = [f"w{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8]}t" for i in range(60)]
    text = lambda bad: " ".join([*rng.choice(plain, 25), *(["grumblefink", "snarkotron"] if bad else [])])
    model = toxicity.fit([(text(i % 2), i % 2) for i in range(300)])
    run_on = "abcdefgh" * 8
    got = toxicity.Scorer(model).raw([run_on, run_on + "grumblefinksnarkotron", run_on + "plainwordsfollowhere"])
    assert got[1] > got[0] and got[1] > got[2]
    # wherever a short phrase stands, one segment holds it whole
    places = [" ".join([*plain[:k], "grumblefink", "snarkotron", *plain[k:40]]) for k in range(24)]
    raw = toxicity.Scorer(model).raw(places)
    assert raw.min() > 0.5 * raw.max() > 0


def test_op7(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op7_simhash_near_dedup", "doc_id:bigint fingerprint:string component_id:bigint")
    prints = {i: brute_fingerprint(t or "") for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    least = {}
    left = set(prints)
    while left:
        queue = [min(left)]
        left -= set(queue)
        root = queue[0]
        while queue:
            i = queue.pop()
            least[i] = root
            near = {j for j in left if (prints[i] ^ prints[j]).bit_count() <= 2}
            left -= near
            queue += near
    assert {r.doc_id: r.component_id for r in rows} == least


def test_op8(spark, sf_dir, texts):
    columns = "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string"
    rows = run(spark, sf_dir, "op8_media_columns", columns)
    seen = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), sha(p), zlib.crc32(p[-64:]))
        assert seen.setdefault(texts[r.doc_id], tuple(r)[1:]) == tuple(r)[1:] and r.media_bytes > len(p)
    assert {r.doc_id for r in rows} == set(texts)


def test_op10(spark, sf_dir, texts):
    import tiktoken

    from tidelog.llm import bpe

    rows = run(spark, sf_dir, "op10_byte_bpe", "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        ids = t.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((texts[r.doc_id] or "").encode()))
    assert {r.doc_id for r in rows} == set(texts)
