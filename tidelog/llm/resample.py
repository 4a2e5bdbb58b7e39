"""Importance resampling of documents towards the word statistics of a target set."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.llm.common import pieces, spread_join, stored, utf8

#: Buckets of features, and words that a document needs to be drawn.
BUCKETS, LEAST_WORDS = 10_000, 20
#: Bytes of text that a task takes apart at a time.
TEXT_BYTES = 1 << 20
#: What bytes become: A-Z lower-cased; all ASCII but letters and digits a space, the rest as it is.
_LOWER = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def buckets(text: bytes) -> tuple[int, np.ndarray]:
    """(words, the bucket of every run of one or two words) of a UTF-8 text, repeats included.

    A word is a run of ASCII letters and digits and of all characters beyond ASCII. A long text is
    read part by part.
    """
    crc, n, last, out = zlib.crc32, 0, None, []
    start = 0
    while start < len(text):
        stop = start + TEXT_BYTES
        part = text[start:stop].translate(_LOWER)
        if stop < len(text):  # back to the end of a word; a word that is longer is read whole
            at = part.rfind(b" ")
            while at < 0 and stop < len(text):
                stop += TEXT_BYTES
                part = text[start:stop].translate(_LOWER)
                at = part.rfind(b" ") if stop < len(text) else len(part)
            part = part[: at + 1]
        start += max(len(part), 1)
        words = part.split()
        n += len(words)
        got = [crc(w) for w in words]
        chain = words if last is None else [last, *words]
        got += [crc(b"%b %b" % p) for p in zip(chain, chain[1:])]
        if words:
            last = words[-1]
        out.append((np.array(got, dtype=np.uint32) % BUCKETS).astype("<u2"))
    return n, np.concatenate(out) if out else np.empty(0, "<u2")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n, n_words, buckets) of each distinct text: its SHA-256, how often it occurs and the buckets of its features.

    Identical texts are grouped by the full text, with partial counts. Null counts as empty.
    """
    grouped = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    keyed = grouped.select(F.unhex(F.sha2("text", 256)).alias("key"), "n", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXT_BYTES):
            got = [buckets(x) for x in utf8(batch.column("text"))]
            columns = [batch.column("key"), batch.column("n"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tobytes() for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "n_words", "buckets"])

    return stored(keyed.mapInArrow(work, "key binary, n long, n_words long, buckets binary"), "features")


def totals(made: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all texts fall into a bucket, copies counted; summed up in every task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for n, got in zip(batch.column("n").to_pylist(), batch.column("buckets").to_pylist()):
                sums += n * np.bincount(np.frombuffer(got, "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    return made.select("n", "buckets").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(have: DataFrame, want: DataFrame) -> np.ndarray:
    """What a feature of each bucket speaks for the target, in thousandths: a table of BUCKETS numbers."""
    s, t = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for sums, counted in ((s, have), (t, want)):
        for r in counted.collect():  # BUCKETS rows at most
            sums[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist())], dtype=np.int64)


def weights(made: DataFrame, table: np.ndarray) -> DataFrame:
    """(key, n, n_words, n_features, weight) of each distinct text; the weight is the floored mean of its features' gains, 0 without."""
    shared = made.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(x, "<u2") for x in batch.column("buckets").to_pylist()]
            means = [int(shared.value[x].sum()) // len(x) if len(x) else 0 for x in got]
            columns = [*(batch.column(c) for c in ("key", "n", "n_words")), pa.array([len(x) for x in got], pa.int64()), pa.array(means, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "n_words", "n_features", "weight"])

    return stored(made.mapInArrow(work, "key binary, n long, n_words long, n_features long, weight long"), "weights")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, in thousandths; it depends on nothing but the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their ``rank`` (1, 2, 3 ...): sorted by ranges, each range's rows numbered from the sum of those before it."""
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return numbered.withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    The ``percent`` of the documents of LEAST_WORDS words or more that have the highest score are
    drawn; ``rank`` is their place (ties to the smaller doc_id), null for all others. Features and
    weight are made once for each distinct text; the noise is each document's own. Null texts have no
    features, a null doc_id has the noise of an empty one and comes first among equals; repeated rows
    are ranked one by one. An empty table gives no rows; without a target all weights follow
    the corpus alone. Other columns are not looked at.
    """
    made = features(docs, text)
    weighed = weights(made, gains(totals(made), totals(features(target, target_text))))
    n_docs = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_words") >= LEAST_WORDS, F.col("n"))), F.lit(0))).first()
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("key"))
    joined = spread_join(keyed, weighed.drop("n"), ["key"], ["doc_id"], total=n_docs[0], counts=weighed)
    scored = stored(joined.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scored")
    enough = F.col("n_words") >= LEAST_WORDS
    placed = ranked(scored.where(enough).drop("n_words"), [F.desc("score"), F.asc("doc_id")])
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= percent * n_docs[1] // 100, F.col("rank")))
    return drawn.unionByName(scored.where(~enough).drop("n_words").withColumn("rank", F.lit(None).cast("long")))
