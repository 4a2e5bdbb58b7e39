"""A corpus pipeline over ``documents``: five stages, each one call of an operator.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, langid, secrets, shingles
from tidelog.llm.common import documents, release, stored

#: A text is rejected if it has no letter, or if its words on average speak by less than this (in log odds) for its
#: best language and against the next. The lowest of 1,000 labelled texts has 1.26; texts of languages that were not
#: learned have 0.0 to 0.5.
LEAST_MARGIN = 0.5
#: Rows of an Arrow batch: texts are long, and a batch lies in an executor's and in its worker's memory at once.
BATCH_ROWS = 2_000
#: Keys of rows to drop that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other names for columns that an operator would make anew, and how to name them back."""
    names = {c: f"{c} of the documents" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(names), {new: c for c, new in names.items()}


def _short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, from now on in this session; no result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(BATCH_ROWS, int(spark.conf.get(key)))))


def _same(docs: DataFrame, out: DataFrame, back: dict[str, str]) -> DataFrame:
    """The columns of ``docs``, those set aside under their own names again."""
    names = {c: new for new, c in back.items()}
    return out.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows whose ``key`` is not in the one column of ``gone``, which is broadcast if it is short; no column is added."""
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, key == gone[gone.columns[0]], "left_anti")


def _name(doc_id: Column, text: Column) -> Column:
    """A name for a row: its id, and 96 bits for its text, since an id may be repeated or null."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.xxhash64(text), F.hash(text))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a known language; where ``lang`` is null it becomes the language found.

    Null and empty texts and those without letters go. Repeated rows are judged alike. Where
    only one language was learned, all texts with letters stay. Columns of any other name stay as they are.
    """
    _short_batches(spark)
    model = langid.train(docs)
    named, back = _aside(docs, "lang_pred", "lang_score", "lang_margin")
    told = langid.identify(named, model)
    kept = told.where(F.col("lang_pred") != langid.UNKNOWN)
    if len(model.languages) > 1:
        kept = kept.where(F.col("lang_margin") >= LEAST_MARGIN)
    return _same(docs, kept.withColumn("lang", F.coalesce("lang", "lang_pred")), back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group; of equal rows, one.

    Groups are linked by pairs whose five-word shingles have a Jaccard similarity of 0.8 or
    more. A row without doc_id cannot be named as a group's keeper and always stays. Columns of any name stay as they are.
    """
    _short_batches(spark)
    found = shingles.near_duplicates(docs).where("doc_id IS NOT NULL")
    row = [F.col("doc_id").alias("id"), F.col("key").alias("k")]
    gone = found.where("NOT keeps").select(*row).distinct()
    twice = stored(found.where("keeps").groupBy(*row).count().where("count > 1").select("id", "k"), "twice")
    dropped = stored(gone.union(twice), "dropped")
    if dropped.count() <= BROADCAST_KEYS:
        dropped, twice = F.broadcast(dropped), F.broadcast(twice)
    same = lambda of: (docs["doc_id"] == of["id"]) & (F.xxhash64(docs["text"]) == of["k"])
    kept = docs.join(dropped, same(dropped), "left_anti")
    if not twice.isEmpty():  # of rows that are equal in id and text, one
        kept = kept.union(docs.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that overlaps an item of the benchmark; null texts overlap none, equal rows go together."""
    named = docs.select(_name(F.col("doc_id"), F.col("text")).alias("name"), "text")
    hits = decontaminate.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="name")
    gone = stored(hits.select(F.col("doc_id").alias("gone")).distinct(), "contaminated")
    return _without(docs, gone, _name(docs["doc_id"], docs["text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found; ``n_chars`` follows the text. Rows without one, null texts among them, stay as they are."""
    _short_batches(spark)
    named, back = _aside(docs, "secret_spans")
    scanned = secrets.scan(named, secrets.train(docs))
    changed = F.size("secret_spans") > 0
    return _same(docs, secrets.redact(scanned).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))), back)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids, and a digest of what they decode to.

    A null text has no ids; each of repeated rows gives a row.
    """
    _short_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written and read again, then its input released."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the stages; the tests compare them with brute force.
ORACLE_SQL = None
