"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import bounded_sample, extended, kept_by_worker, pieces, texts

#: Labelled rows of each class that training takes, and characters of such a row at most.
SAMPLE_ROWS, SAMPLE_CHARS = 2_500, 20_000
#: Vectors are kept for so many hashed n-grams, of so many numbers each.
BUCKETS, DIM = 1 << 16, 6
#: Shortest and longest n-gram of a word between < and >.
SHORTEST, LONGEST = 3, 6
#: Words of a block; two blocks on end are a segment, whose words are averaged together.
BLOCK = 8
#: A longer run of letters counts as several words, which overlap so that no n-gram is lost.
LONG_RUN = 40
#: Words whose scores a Python worker keeps, and bytes of text that are held split up.
CACHE_WORDS, TEXT_BYTES = 400_000, 2 << 20
_WORDS = regex.compile(r"\p{L}+")
_PRIME = 0x9E3779B97F4A7C15  # odd, so products keep all 64 bits apart


def words(text: str) -> list[str]:
    """The lower-cased runs of letters between < and >, long ones in pieces of LONG_RUN characters."""
    found = [f"<{w}>" for w in _WORDS.findall(text.lower())]
    if found and max(map(len, found)) > LONG_RUN:
        step = LONG_RUN - LONGEST + 1
        found = [w[i : i + LONG_RUN] for w in found for i in range(0, max(1, len(w) - LONGEST + 1), step)]
    return found


def buckets(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word itself and of its character n-grams, one after another, and how many a word has."""
    sizes = np.array([len(w) for w in found], dtype=np.int64)
    chars = np.frombuffer("".join(found).encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(found)), sizes)
    left = ends[owner] - np.arange(len(chars))  # characters from here to the word's end
    powers = np.cumprod(np.full(max(int(sizes.max(initial=1)), LONGEST), _PRIME, dtype=np.uint64))
    hashes = [np.add.reduceat(chars * powers[np.arange(len(chars)) - (ends - sizes)[owner]], ends - sizes) if len(found) else chars]
    owners = [np.arange(len(found))]
    grown = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        grown[: len(chars) - n + 1] += chars[n - 1 :] * powers[n - 1]
        if n >= SHORTEST:
            fits = left >= n
            hashes.append(grown[fits] ^ np.uint64(n))
            owners.append(owner[fits])
    flat, of_word = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(of_word, kind="stable")
    flat = (flat ^ (flat >> np.uint64(29))) * np.uint64(_PRIME) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return flat[order].astype(np.int64), np.bincount(of_word, minlength=len(found))


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts of ``counts`` words, one after another: their text, first block, last block, and words.

    Segments overlap by a block; a text of one block is one segment.
    """
    n_blocks = -(-counts // BLOCK)
    first_block = np.cumsum(n_blocks) - n_blocks
    size = np.full(int(n_blocks.sum()), BLOCK, dtype=np.int64)
    size[(first_block + n_blocks - 1)[counts > 0]] = (counts - BLOCK * (n_blocks - 1))[counts > 0]
    n = np.where(counts > 0, np.maximum(n_blocks - 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), n)
    first = first_block[text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
    last = np.where(n_blocks[text] > 1, first + 1, first)
    held = size[first] + np.where(last > first, size[last], 0)
    return text, first, last, held


@dataclass
class Model:
    """``odds``: each bucket's vector times the difference of the two softmax rows; and the calibration."""

    odds: np.ndarray
    slope: float
    bias: float

    def words(self, found: list[str]) -> np.ndarray:
        """The mean of each word's buckets."""
        flat, counts = buckets(found)
        return np.add.reduceat(self.odds[flat], np.cumsum(counts) - counts) / counts if found else np.empty(0)


class Scorer:
    """Scores of a model; the words met are kept, and forgotten when they are too many."""

    def __init__(self, model: Model):
        self.model, self.at, self.values = model, {}, np.empty(0)

    def raw(self, docs: list[str]) -> np.ndarray:
        """The highest mean over a text's segments; 0 without words."""
        rows = [words(x) for x in docs]
        if len(self.at) > CACHE_WORDS:
            self.at, self.values = {}, np.empty(0)
        found = [list(map(self.at.get, row)) for row in rows]
        late = [i for i, places in enumerate(found) if None in places]
        new = list(dict.fromkeys(w for i in late for w, at in zip(rows[i], found[i]) if at is None))
        if new:
            self.at.update(zip(new, range(len(self.values), len(self.values) + len(new))))
            self.values = np.concatenate([self.values, self.model.words(new)])
        for i in late:
            found[i] = list(map(self.at.__getitem__, rows[i]))
        counts = np.array([len(x) for x in found], dtype=np.int64)
        out = np.zeros(len(docs))
        if counts.any():
            values = self.values[np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum()))]
            text, first, last, held = _segments(counts)
            starts = np.concatenate([np.arange(0, n, BLOCK) + at for at, n in zip(np.cumsum(counts) - counts, counts)])
            sums = np.add.reduceat(values, starts)
            z = (sums[first] + np.where(last > first, sums[last], 0.0)) / np.maximum(held, BLOCK)
            some = np.flatnonzero(counts)
            out[some] = np.maximum.reduceat(z, np.searchsorted(text, some))
        return out

    def score(self, docs: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * self.raw(docs) + self.model.bias, -30, 30)))


def fit(samples: list[tuple[str, int]], rounds: int = 150, seed: int = 7) -> Model:
    """Learn from (text, 0 or 1) pairs.

    Word vectors are the mean of their buckets' vectors, segment vectors the mean of their
    words'; the softmax row of each class and the vectors are learned together. A toxic text
    needs one toxic segment, so after some rounds over whole texts its highest segment alone
    is pushed up; of other texts all are pushed down. Buckets seen in fewer than three texts
    stay at zero. A sixth of the texts, unseen by the vectors, calibrates the score.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    samples = [samples[i] for i in order]
    cut = len(samples) // 6
    learn, check = samples[cut:], samples[:cut]
    vocabulary: dict[str, int] = {}
    tokens, sizes, labels = array("i"), [], []
    for text, label in learn:
        if found := words(text):
            tokens.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
            sizes.append(len(found))
            labels.append(label)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, -4.0 if not labels or labels[0] == 0 else 4.0)
    tok, y, counts = np.array(tokens), np.array(labels, dtype=float), np.array(sizes)
    seg_doc, seg_first, seg_last, held = _segments(counts)
    denominator = np.maximum(held, BLOCK).astype(float)
    two = seg_last > seg_first
    tok_doc = np.repeat(np.arange(len(y)), counts)
    place = np.arange(len(tok)) - (np.cumsum(counts) - counts)[tok_doc]
    n_blocks = -(-counts // BLOCK)
    tok_block = (np.cumsum(n_blocks) - n_blocks)[tok_doc] + place // BLOCK
    # a bucket must occur in three texts
    flat, per_word = buckets(list(vocabulary))
    n_words = len(vocabulary)
    del vocabulary
    of_word = np.repeat(np.arange(n_words, dtype=np.int32), per_word)
    pairs = np.unique(tok * np.int64(len(y)) + tok_doc)
    met = np.bincount(pairs // len(y), minlength=n_words)
    seen = np.bincount(flat, weights=met[of_word], minlength=BUCKETS)
    use = seen[flat] >= 3
    flat, of_word = flat[use], of_word[use]
    weight = (1.0 / per_word[of_word]).astype(np.float32)
    n_segs = np.bincount(seg_doc, minlength=len(y))
    first = np.concatenate([[0], np.cumsum(n_segs)[:-1]])

    vec = rng.normal(0, 0.1, (BUCKETS, DIM))
    row = rng.normal(0, 0.1, DIM)  # the difference of the softmax rows
    bias = float(np.log(y.mean() / (1 - y.mean())))
    state = [np.zeros_like(vec), np.zeros_like(vec), np.zeros_like(row), np.zeros_like(row)]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(1, rounds + 1):
        scalar = vec @ row
        word_odds = np.bincount(of_word, weights=scalar[flat] * weight, minlength=n_words)
        sums = np.bincount(tok_block, weights=word_odds[tok], minlength=int(n_blocks.sum()))
        z = (sums[seg_first] + np.where(two, sums[seg_last], 0.0)) / denominator + bias
        if step <= rounds // 4:
            share = 1.0 / n_segs[seg_doc]
        else:
            top = np.maximum.reduceat(z, first)[seg_doc] == z
            share = np.where(y[seg_doc] > 0, top, 0.5 * top + 0.5 / n_segs[seg_doc])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = (p - y[seg_doc]) * share * balance[seg_doc] / len(y)
        block_g = np.bincount(seg_first, weights=g / denominator, minlength=len(sums))
        block_g += np.bincount(seg_last[two], weights=(g / denominator)[two], minlength=len(sums))
        word_g = np.bincount(tok, weights=block_g[tok_block], minlength=n_words)
        bucket_g = np.bincount(flat, weights=word_g[of_word] * weight, minlength=BUCKETS)
        grads = (bucket_g[:, None] * row[None, :] + 1e-7 * vec, bucket_g @ vec)
        bias -= 0.5 * float(g.sum())
        for value, grad, m, v in zip((vec, row), grads, state[::2], state[1::2]):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            value -= move * (bucket_g != 0)[:, None] if value is vec else move
    model = Model(vec @ row, 1.0, bias)
    held = check if len({label for _, label in check}) > 1 else samples
    scorer = Scorer(model)
    x = np.concatenate([scorer.raw([text for text, _ in held[k : k + 256]]) for k in range(0, len(held), 256)])
    t = np.array([label for _, label in held], dtype=float)
    scale = max(float(np.abs(x).max()), 1e-9)
    u = x / scale
    a, b = 5.0, 0.0
    equal = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    for _ in range(400):  # logistic regression on one number, classes weighed equally
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        e, h = (p - t) * equal, np.maximum(p * (1 - p), 1e-4) * equal
        hess = np.array([[(h * u * u).mean() + 1e-4, (h * u).mean()], [(h * u).mean(), h.mean() + 1e-4]])
        da, db = np.linalg.solve(hess, [(e * u).mean() + 1e-4 * a, e.mean()])
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-6:
            break
    model.slope, model.bias = float(a / scale), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample: about SAMPLE_ROWS rows of each label, chosen by a hash of ``key``.

    The sample is drawn from ``labels`` alone and then meets ``docs`` in a broadcast join, which
    its bound allows; no text is shuffled but the sample's. Labels other than 0 and 1, and texts
    that are null or over SAMPLE_CHARS characters, are left out of training. Of rows of one key,
    the highest label and the smallest text count.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    sample = bounded_sample(known.groupBy("key").agg(F.max("label").alias("label")), F.col("key"), F.col("label"), SAMPLE_ROWS)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    found = rows.join(F.broadcast(sample), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return fit(sorted((r["text"], r["label"]) for r in found.collect()))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``toxic_score`` (0 to 1), which replaces one of that name.

    Whole texts count: a text scores as its most toxic segment of 16 words, and segments overlap
    by half. Null, empty and wordless texts
    score as a text whose words say nothing. No other column is read.
    """
    names = [c for c in docs.columns if c != "toxic_score"]
    kept = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, text, TEXT_BYTES):
            scorer = kept_by_worker(("toxicity", id(m)), lambda: Scorer(m))  # a scorer holds its model, so the id stays its own
            got = pa.array(scorer.score(texts(batch.column(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*names, "toxic_score"])

    return kept.mapInArrow(work, extended(kept, toxic_score=T.DoubleType()))
