"""The pipeline's run() against brute force on a small corpus, and languages that were not learned."""

import hashlib
import itertools
import json

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidelog.llm import bpe, langid, secrets
from test_llm_operators import brute_overlap
from test_near_dedup import edited, groups

ITALIAN = "il gatto e il cane sono nella casa grande con la madre che dorme e poi esce a comprare il pane"
POLISH = "ala ma kota i pies jest w domu bardzo wielki a mama idzie do sklepu po chleb oraz mleko"


def test_run_equals_brute_force(spark, sf_dir, tmp_path):
    rng = np.random.default_rng(21)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 2500).limit(70)
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(3).collect()] + ["six words that are exactly these"]
    rows = [tuple(r) for r in docs.collect()]
    base = rows[0][1].split()[:80]
    more = [" ".join(edited(rng, base, n)) for n in (0, 1, 2, 30)]
    more += [f"{' '.join(base[5:60])} {bench[0]} {' '.join(base[:9])}", "and the house of the man with six words that are exactly these", ITALIAN, POLISH, "12 34", "", None]
    more += [f"the and of the house and token = 'Zx81kdlsAbcd{i}' and the end of the house" for i in range(2)]
    rows += [(10_000 + i, t, None if i % 2 else "en", "s", len(t or "")) for i, t in enumerate(more)]
    rows += [(10_003, more[3], "en", "s", 5), (None, "the house of the man and the woman in the town", "en", "s", 40)]
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect())

    model = langid.train(spark.createDataFrame(rows, docs.schema))
    told = langid.Scorer(model).predict([r[1] or "" for r in rows])
    rows = [(*r[:2], r[2] or t[0], *r[3:]) for r, t in zip(rows, told) if t[0] != "und" and t[2] >= pipeline.LEAST_MARGIN]
    assert not {10_006, 10_007, 10_008, 10_009, 10_010} & {r[0] for r in rows}
    hashed = {t: h for t, h in spark.createDataFrame([(r[1],) for r in rows], "t string").select("t", F.xxhash64("t")).collect()}
    named = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], hashed[r[1]]))
    of = groups([(i, r[1]) for i, r in enumerate(named)])
    kept = [r for i, r in enumerate(named) if of[i] == i] + [r for r in rows if r[0] is None]
    # equal rows of one id: the operator keeps one of (doc_id, text)
    kept = list({(r[0], r[1]): r for r in kept}.values())
    clean = [r for r in kept if not any(brute_overlap(r[1], x) for x in bench)]
    assert len(clean) < len(kept) < len(rows)
    fit_on = spark.createDataFrame(clean, docs.schema)
    net = secrets.train(fit_on)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in clean:
        covered = set().union(*(range(s["start"], s["end"]) for s in secrets._spans(net, r[1])), set())
        runs = itertools.groupby(enumerate(r[1]), key=lambda x: x[0] in covered)
        text = "".join("[secret]" if hit else "".join(c for _, c in run) for hit, run in runs)
        ids = coder.encode_ordinary(text)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((str(r[0]), len(ids), sha(json.dumps(ids)[1:-1].replace(" ", "").encode()), sha(text.encode())))
    assert got == sorted(want)
