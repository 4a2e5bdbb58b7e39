"""The pipeline's stages: decisions, columns kept, and rows that must stay."""

import corpus_pipeline as pipeline
from tidelog.llm import secrets


def test_stages_over_the_small_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame(
        [(None, "a text without an id, and with words enough to stay", None, "s", 50), (10**6, "12 34 !!", None, "s", 8), (10**6 + 1, None, "en", "s", 0)],
        docs.schema,
    )
    docs, bench = docs.unionByName(extra), spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rows = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).checkpoint()
        rows[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in rows[name]}
    assert None in ids("byte_bpe") and not {10**6, 10**6 + 1} & ids("language_id")
    assert next(r for r in rows["language_id"] if r.doc_id is None).lang is not None
    texts = [r.text for r in rows["near_dedup"]]
    assert len(set(texts)) == len(texts) < len(rows["language_id"])
    left = "\n".join(r.text for r in rows["decontamination"])
    assert not any(b.text in left for b in bench)
    assert not any(secrets.base_spans(r.text) for r in rows["secret_scan"])
    assert ids("secret_scan") == ids("decontamination") == ids("byte_bpe")
    assert all(r.n_chars == len(r.text) for r in rows["secret_scan"] if "[secret]" in r.text)
