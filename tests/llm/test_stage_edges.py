"""Stages on empty tables and on columns that have an operator's names; the secret network on a kind it never saw."""

import random
import string
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidelog.llm import common, media, queries, secrets


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mine = {"lang_pred": F.lit("mine"), "lang_score": F.lit(7), "lang_margin": F.lit("m"), "secret_spans": F.lit("none"), "__key": F.lit("k"), "id": F.lit("i"), "k": F.lit(3), "gone": F.lit(True), "name": F.lit("n")}
    return own.where("doc_id < 60 AND length(text) < 4000").withColumns(mine)


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_other_columns_stay_and_empty_tables_pass(spark, sf_dir, docs, name, stage):
    out = stage(spark, docs, sf_dir)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert rows and {(r.lang_pred, r.lang_score, r.lang_margin, r.secret_spans, r["__key"], r.id, r.k, r.gone, r.name) for r in rows} == {("mine", 7, "m", "none", "k", "i", 3, True, "n")}
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    none = stage(spark, plain.where("false"), sf_dir)
    assert none.columns == plain.columns and none.count() == 0


def test_last_stage_on_an_empty_table(spark, sf_dir, docs):
    assert pipeline.byte_bpe(spark, docs.where("false"), sf_dir).count() == 0


def test_media_refuses_columns_with_names_of_features(spark):
    given = media.to_media(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(ValueError, match="height"):
        media.features(given.withColumn("height", F.lit(1)))


def test_scores_of_the_secret_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op4_secret_scan(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    net = secrets.train(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    assert sum(r.n_scored for r in rows) > 0
    for r in rows:
        spans, scores = secrets._scored(net, texts[r.doc_id])
        every = set(secrets.candidates(texts[r.doc_id])) | {(s, e) for s, _, e in secrets.base_spans(texts[r.doc_id])}
        assert r.n_scored == len(scores) and r.n_scored >= len(set(secrets.candidates(texts[r.doc_id]))) and (every == set()) == (r.n_scored == 0)
        assert r.n_model == sum(x["kind"] == "model" for x in spans) and all(0 <= x["score"] <= 1 for x in spans)
        assert r.top_score == (round(max(scores), 6) if scores else None)


def test_recall_on_a_kind_that_training_never_saw(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    found = [x for t in texts if "AKIA" not in t for x in secrets.findings(t)]
    assert not any(b"AKIA" in v for v, _, _ in found)
    net = secrets.fit(sorted(found))
    rng = random.Random(4)
    keys = ["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)) for _ in range(300)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    told = [max(secrets._scores(net, f"the house {k} and the", [(10, 10 + len(k))])) >= net.threshold for k in keys]
    assert sum(told) >= 0.9 * len(keys)


def test_a_rule_match_without_a_digit_is_scored(spark):
    docs = spark.createDataFrame([(1, "password = correcthorsebattery and more")], "doc_id long, text string")
    net = secrets.fit([])
    (row,) = secrets.scan(docs, net, scores=True).collect()
    assert [s.kind for s in row.secret_spans] == ["assign"] and row.secret_spans[0].score is not None and len(row.secret_scores) == 1


def test_idle_workers_let_go_of_what_they_keep(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.4)
    for name in ("_KEPT", "_USED"):
        monkeypatch.setattr(common, name, {})
    made = []
    for _ in range(6):  # asked for again and again, it stays
        assert common.kept_by_worker("a", lambda: made.append(1) or made) is made
        time.sleep(0.1)
    assert made == [1]
    time.sleep(1.2)
    assert not common._KEPT
    common.kept_by_worker("a", lambda: made.append(1) or made)
    assert made == [1, 1]
