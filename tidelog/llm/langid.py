"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import bounded_sample, extended, kept_by_worker, pieces, texts

#: Rows per language that the model learns from, and words and n-grams per language that it keeps.
SAMPLE_ROWS, KEEP_WORDS, KEEP_GRAMS = 4_000, 20_000, 8_000
#: Longest character n-gram. Words are wrapped in spaces, so n-grams see where they begin and end.
LONGEST = 4
#: The log odds of one word count in full up to this, so that no single word decides a text.
WORD_LIMIT = 6.0
UNKNOWN = "und"

#: Words whose scores a Python worker keeps, and bytes of text that are held split up.
CACHE_WORDS, TEXT_BYTES = 200_000, 1 << 20

_LETTERS = regex.compile(r"\p{L}+")
_LETTERS_JAVA = r"(\p{L}+)"


@dataclass
class Model:
    """Scores by language in the rows of ``table``; ``known`` words (" word ") and ``grams`` by length name rows."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray
    known: dict[str, int]
    grams: list[dict[str, int]]

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of lower-cased words: each language's log frequency, less their mean.

        A known word has its own. Else each longest n-gram that is known counts; where none of
        a length is, the next shorter length is tried.
        """
        rows: list[int] = []
        counts, lengths = np.zeros(len(words), dtype=np.int64), np.ones(len(words))
        for k, word in enumerate(words):
            wrapped = f" {word} "
            if (own := self.known.get(wrapped)) is not None:
                rows.append(own)
                counts[k] = 1
                continue
            for n in range(LONGEST, 0, -1):
                get = self.grams[n - 1].get
                found = [x for i in range(len(wrapped) - n + 1) if (x := get(wrapped[i : i + n])) is not None]
                if found:
                    rows += found
                    counts[k], lengths[k] = len(found), n
                    break
        out = np.zeros((len(words), len(self.languages)))
        some = counts > 0
        if rows:
            sums = np.add.reduceat(self.table[rows], (np.cumsum(counts) - counts)[some])
            # a word's n-grams overlap: together they weigh as about len / n independent ones
            out[some] = np.clip(sums / lengths[some, None], -WORD_LIMIT, WORD_LIMIT)
        return out


class Scorer:
    """Predictions of a model; the scores of words met are kept, and forgotten when they are too many."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.scores = np.empty((0, len(model.languages)))

    def _places(self, rows: list[list[str]]) -> list[list[int]]:
        """The words' rows of ``scores``, which takes in the words that it lacks."""
        if len(self.at) > CACHE_WORDS:
            self.at, self.scores = {}, self.scores[:0]
        found = [list(map(self.at.get, row)) for row in rows]
        late = [i for i, places in enumerate(found) if None in places]
        new = list(dict.fromkeys(w for i in late for w, at in zip(rows[i], found[i]) if at is None))
        if new:
            self.at.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.words(new)])
        for i in late:
            found[i] = list(map(self.at.__getitem__, rows[i]))
        return found

    def predict(self, docs: list[str]) -> list[tuple[str, float, float]]:
        """The language of each text, its posterior, and by how much each word speaks for it and
        against the next one on average; ``und``, 0 and 0 for a text without letters."""
        out = []
        model, known = self.model, len(self.model.languages)
        rows = [_LETTERS.findall(x.lower()) if known else [] for x in docs]
        for places in self._places(rows):
            if not places:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            sums = self.scores[places].sum(axis=0)
            total = sums + model.prior
            best = int(total.argmax())
            others = np.delete(sums, best)
            margin = (sums[best] - others.max()) / len(places) if len(others) else 0.0
            out.append((model.languages[best], float(1 / np.exp(total - total[best]).sum()), float(margin)))
        return out


def _top(counts: DataFrame, keep: int, *by: str) -> DataFrame:
    """The ``keep`` most frequent keys of each group; ties by key."""
    order = Window.partitionBy("lang", *by).orderBy(F.desc("n"), "key")
    return counts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= keep).drop("__r")


def _tables(rows: list, languages: list[str], smooth: float, table: list[np.ndarray]) -> dict[str, int]:
    """The rows that ``table`` gets for each key: its log frequency, less the mean over languages."""
    at = {x: i for i, x in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["key"], np.zeros(len(languages)))[at[r["lang"]]] += r["n"]
    if not counts:
        return {}
    values = np.array(list(counts.values()))
    logs = np.log((values + smooth) / (values.sum(axis=0) + smooth * len(values)))
    start = sum(map(len, table))
    table.append(np.clip(logs - logs.mean(axis=1, keepdims=True), -WORD_LIMIT, WORD_LIMIT))
    return dict(zip(counts, range(start, start + len(counts))))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from a bounded sample: about SAMPLE_ROWS rows of each language, chosen by a hash of ``key``.

    Rows without language or text are left out. Words and n-grams are counted by Spark, with
    partial sums before each shuffle; the model keeps KEEP_WORDS words and, of each length,
    KEEP_GRAMS n-grams per language, so it has a fixed greatest size.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sample = bounded_sample(rows, F.col("key"), F.col("lang"), SAMPLE_ROWS)
    counted = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS_JAVA), F.lit(1))).alias("w"))
        .groupBy("lang", "w")
        .agg(F.count("*").alias("n"))
        .select("lang", F.concat(F.lit(" "), "w", F.lit(" ")).alias("key"), "n")
    )
    counted = counted.persist()
    try:
        words = _top(counted.where("n > 1"), KEEP_WORDS).collect()
        grams = counted.select(
            "lang",
            "n",
            F.explode(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.lit(LONGEST)),
                        lambda k: F.transform(
                            F.when(
                                F.length("key") >= k, F.sequence(F.lit(1), F.length("key") - k + 1)
                            ).otherwise(F.array().cast("array<int>")),
                            lambda i: F.struct(k.alias("size"), F.substring(F.col("key"), i, k).alias("key")),
                        ),
                    )
                )
            ).alias("g"),
        ).select("lang", "n", F.col("g.size").alias("size"), F.col("g.key").alias("key"))
        top = _top(grams.groupBy("lang", "size", "key").agg(F.sum("n").alias("n")), KEEP_GRAMS, "size").collect()
    finally:
        counted.unpersist()
    languages = sorted({r["lang"] for r in words} | {r["lang"] for r in top})
    table: list[np.ndarray] = [np.empty((0, len(languages)))]
    known = _tables(words, languages, 0.5, table)
    grams = [_tables([r for r in top if r["size"] == n], languages, 0.5, table) for n in range(1, LONGEST + 1)]
    return Model(languages, np.full(len(languages), -math.log(max(1, len(languages)))), np.concatenate(table), known, grams)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``lang_pred``, ``lang_score`` and ``lang_margin`` (which replace columns of these names).

    ``lang_pred`` is a learned language, or ``und`` with score and margin 0 where the text is
    null, empty or has no letter; the score is the posterior of the language. The margin is the
    mean over all words by how much they speak for it and against the next language: near 0 for
    words of no learned language, whatever their number. Ties go to the language that is first
    by name. No other column is read.
    """
    new = {"lang_pred": T.StringType(), "lang_score": T.DoubleType(), "lang_margin": T.DoubleType()}
    names = [c for c in docs.columns if c not in new]
    kept = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, text, TEXT_BYTES):
            scorer = kept_by_worker(("langid", id(m)), lambda: Scorer(m))  # a scorer holds its model, so the id stays its own
            columns = zip(*scorer.predict(texts(batch.column(text))))
            got = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *got], [*names, *new])

    return kept.mapInArrow(work, extended(kept, **new))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
