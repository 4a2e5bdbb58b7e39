"""Near duplicates at a Jaccard similarity of word shingles, exactly: blocks of a partition of all shingles, verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import partition, simhash
from tidelog.llm.common import bounded_sample, extended, pieces, release, spread_join, stored, utf8
from tidelog.llm.components import connected_components

#: Words of a shingle; texts are near duplicates at PART / WHOLE of similarity or more.
WIDTH, PART, WHOLE = 5, 4, 5
#: Texts that tell which shingles are common, and the most that are listed. Both only bear on speed.
SAMPLE_TEXTS, COMMON = 5_000, 200_000
#: Texts to verify that are picked out by a broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Bytes of text that a task takes apart at a time.
TEXT_BYTES = 2 << 20
#: Numbers of a text's sketch: how many of its shingles fall into each class of hashes; at most so many are in the
#: finer one, which has a class for each shingle or more.
CLASSES, FINE_CLASSES = 128, 1 << 14
#: Blocks of a text, the least ones, by which a pair is known to meet in an earlier block.
LEAST, NO_BLOCK = 16, (1 << 63) - 1
#: Rounds in which texts meet one of their block, and pairs expected for each row of a block that end them.
ROUNDS, PAIRS_PER_ROW = 8, 8
#: Rows of a block that are held against each other in a task.
TILE = 2048
#: Rows of a run that is compared together with others.
SMALL = 16


def words_hash(text: bytes) -> bytes:
    """128 bits for the words of a text: texts of the same words have the same shingles."""
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of ``width`` words as sorted hashes.

    A-Z are lower-cased, words are runs without ASCII white space; a shorter text is one
    shingle, none has none. A shingle's hash mixes its words' hashes in order.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words))], dtype=np.uint64).view(np.int64)
    own = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    places = partition.mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)  # an odd number for each place
    got = own[:n] * places[:1]
    for i in range(1, width):
        got += own[i : i + n] * places[i : i + 1]
    got = np.sort(partition.mix(got).view(np.int64))
    new = np.ones(n, dtype=bool)
    np.not_equal(got[1:], got[:-1], out=new[1:])
    return got[new]


def alike(n_common: int, n_a: int, n_b: int) -> bool:
    """True if sets of these sizes have the similarity: c / (a + b - c) >= PART / WHOLE."""
    return n_common * (PART + WHOLE) >= PART * (n_a + n_b)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and their counts, of the shingles that many texts of a bounded sample have."""
    sample = bounded_sample(texts.withColumn("g", F.lit(0)), F.col("node"), F.col("g"), SAMPLE_TEXTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in utf8(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text))], ["h"])

    counted = sample.select("text").mapInArrow(work, "h long").groupBy("h").count().where("count > 2")
    rows = sorted((r[0], r[1]) for r in counted.orderBy(F.desc("count"), "h").limit(COMMON).collect())
    return np.array([h for h, _ in rows], dtype=np.int64), np.array([n for _, n in rows], dtype=np.int64)


def sketch(hashes: np.ndarray, classes: int = CLASSES) -> bytes:
    """How many shingles fall into each class, in a byte each, in units of 2 ** (the first byte), rounded up.

    Sets can't have more in common than the lesser of these numbers, summed up.
    """
    n = np.bincount(hashes & (classes - 1), minlength=classes)
    unit = max(0, int(n.max()).bit_length() - 8)
    if -(-int(n.max()) >> unit) > 255:
        unit += 1
    return bytes([unit]) + (-(-n >> unit)).astype(np.uint8).tobytes()


def counts(sketches: list[bytes]) -> np.ndarray:
    """The numbers of sketches of one length, a row for each."""
    rows = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
    units, n = rows[:, :1], rows[:, 1:]
    return n.astype(np.int64) << units.astype(np.int64) if units.any() else n


def fine(hashes: np.ndarray) -> bytes:
    """A sketch with as many classes as shingles or more, a power of two."""
    return sketch(hashes, min(FINE_CLASSES, max(CLASSES, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 1)))


def room(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """True if sets with these sketches, of any numbers of classes, may be alike."""
    x, y = (counts([s])[0].astype(np.int64) for s in (a, b))
    classes = min(len(x), len(y))
    x, y = (z.reshape(-1, classes).sum(axis=0) for z in (x, y))
    return alike(int(np.minimum(x, y).sum()), n_a, n_b)


def _likely(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for the similarity: most others go before any text is moved."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    told = spread_join(pairs, side("a"), ["a"], ["b"]).join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b"))
            if len({*map(len, a), *map(len, b)}) == 1:
                most = np.minimum(counts(a), counts(b)).sum(axis=1, dtype=np.int64)
                keep = most * (PART + WHOLE) >= PART * (np.array(n_a) + np.array(n_b))
            else:
                keep = [room(*row) for row in zip(a, b, n_a, n_b)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(told.mapInArrow(may_be, "a long, b long"), "likely")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike; ``pairs`` are released.

    Finer sketches come first: texts are joined only to the pairs that these leave.
    """
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    if nodes.count() <= BROADCAST_KEYS:
        nodes_ = F.broadcast(nodes)
    else:
        nodes_ = nodes

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXT_BYTES):
            got = pa.array([fine(shingle_hashes(x)) for x in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], ["node", "n", "text", "sketch"])

    picked = texts.select("node", "n", "text").join(nodes_, "node", "left_semi")
    picked = stored(picked.mapInArrow(sketched, "node long, n long, text string, sketch binary"), "alike")
    likely = _likely(picked, pairs)
    picked_ = picked.select("node", "text")
    both = spread_join(likely, picked_.toDF("a", "text_a"), ["a"], ["b"]).join(picked_.toDF("b", "text_b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
            keep = []
            for x, y in zip(utf8(batch.column("text_a")), utf8(batch.column("text_b"))):
                p, q = shingle_hashes(x), shingle_hashes(y)
                keep.append(alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long").distinct(), "links")
    release(pairs, nodes, picked, likely)
    return out


def _hashed(keyed: DataFrame) -> DataFrame:
    """(doc_id, key, who) of rows: ``who`` stands for the words of a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXT_BYTES):
            got = pa.array([words_hash(x) for x in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), got], ["doc_id", "key", "who"])

    return stored(keyed.mapInArrow(work, extended(keyed.select("doc_id", "key"), who=T.BinaryType())), "prints")


def _texts(alone: DataFrame) -> DataFrame:
    """(who, n, sketch, text, node): one row for texts of the same words, with the number of its shingles, their sketch and a number of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXT_BYTES):
            rows = utf8(batch.column("text"))
            sets = [shingle_hashes(x) for x in rows]
            columns = [
                pa.array([words_hash(x) for x in rows], pa.binary()),
                pa.array([len(h) for h in sets], pa.int64()),
                pa.array([sketch(h) for h in sets], pa.binary()),
                batch.column("text"),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["who", "n", "sketch", "text"])

    made = alone.select("text").mapInArrow(work, "who binary, n long, sketch binary, text string")
    return stored(made.withColumn("node", F.monotonically_increasing_id()), "texts")


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints of five-word shingles are equal or differ in two bits, by one text of each fingerprint."""
    prints = stored(simhash.fingerprints(texts, keep=("node",), width=WIDTH), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("node").alias("first")), "first")
    same = spread_join(prints, first, ["fp"], ["node"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.near_pairs(first).join(first.toDF("a", "node_a"), "a").join(first.toDF("b", "node_b"), "b")
    out = stored(same.union(near.select("node_a", "node_b")), "near")
    release(prints, first)
    return out


def _mixed(blocks: DataFrame, roots: DataFrame, texts: DataFrame, distinct: bool = False) -> DataFrame:
    """(h, node, root, rows, n, sketch, least): the blocks whose texts are of several groups so far, and how many rows each has.

    Of the texts, their sketches and the LEAST least blocks that each is in, in order. Groups only grow, so what
    an earlier call gave has all blocks that can be of several groups; its rows are ``distinct``.
    """
    once = blocks.select("h", "node") if distinct else stored(blocks.select("h", "node").distinct(), "distinct")
    rooted = spread_join(once, roots, ["node"], ["h"], how="left").select("h", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    several = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    mixed = stored(spread_join(rooted, several.select("h", F.col("n").alias("rows")), ["h"], ["node"], counts=several), "several")
    least = F.slice(F.concat(F.sort_array(F.collect_list("h")), F.array_repeat(F.lit(NO_BLOCK), LEAST)), 1, LEAST)
    of = mixed.groupBy("node").agg(least.alias("least")).join(texts.select("node", "n", "sketch"), "node")
    out = stored(spread_join(mixed, of, ["node"], ["h"]), "mixed")
    release(once, rooted, mixed)
    return out


def _tiles(mixed: DataFrame, pairs: bool) -> DataFrame:
    """Rows of ``mixed`` by (h, p, q), sorted within tasks.

    A block of more than TILE rows is cut into tiles by a hash; with ``pairs`` each row comes once for each
    pair (p, q) of tiles that its own is part of, else p and q are its own tile and ``least``, of no use there, is left out.
    """
    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    cut = mixed.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    others = F.sequence(F.lit(0), tiles - 1) if pairs else F.array("tile")
    dealt = cut.withColumn("other", F.explode(others)).withColumns({"p": F.least("tile", "other"), "q": F.greatest("tile", "other")})
    columns = ["h", "p", "q", "tile", "rows", "node", "root", "n", "sketch", *["least"] * pairs]
    return dealt.select(*columns).repartition("h", "p", "q").sortWithinPartitions("h", "p", "q", "root", "node")


def _met(least: np.ndarray, h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) of a block also meet in a lesser one: it is among the least of both."""
    out = np.empty(len(i), dtype=bool)
    for k in range(0, len(i), 4096):
        a, b = least[i[k : k + 4096]], least[j[k : k + 4096]]
        same = (a[:, :, None] == b[:, None, :]) & (a < h[i[k : k + 4096], None])[:, :, None]
        out[k : k + 4096] = same.any(axis=(1, 2))
    return out


def _room(own: np.ndarray, n: np.ndarray, i, j) -> np.ndarray:
    """Which of the pairs of rows (i, j) may be alike by their sketches; some pairs at a time."""
    i, j = np.broadcast_arrays(np.asarray(i), np.asarray(j))
    most = np.empty(len(i), dtype=np.int64)
    for k in range(0, len(i), 4096):
        part = slice(k, k + 4096)
        most[part] = np.minimum(own[i[part]], own[j[part]]).sum(axis=1, dtype=np.int64)
    return most * (PART + WHOLE) >= PART * (n[i] + n[j])


def _pairs_of(runs: dict[str, np.ndarray], starts: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of ``_compared`` in rows that are whole runs, beginning at ``starts``."""
    node, root, n, tile, own = (runs[c] for c in ("node", "root", "n", "tile", "sketch"))
    sizes = np.diff(starts, append=len(node))
    if round_:
        mixed = partition.mix(node.view(np.uint64) + np.full(len(node), round_, np.uint64))
        least = np.repeat(np.minimum.reduceat(mixed, starts), sizes)
        at = np.flatnonzero(mixed == least)
        run = np.repeat(np.arange(len(starts)), sizes)
        head = np.zeros(len(starts), dtype=np.int64)
        head[run[at]] = at
        i, j = head[run], np.arange(len(node))
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        good = _room(own, n, i, j)
        return i[good], j[good]
    cross = runs["p"] != runs["q"]
    left, right = [], []
    end = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, int(sizes.max()))):  # short runs all at once, by the distance of the rows
        i = np.flatnonzero(small & (np.arange(len(node)) + d < end))
        j = i + d
        apart = (root[i] != root[j]) & ~(cross[i] & (tile[i] == tile[j]))
        i, j = i[apart], j[apart]
        good = _room(own, n, i, j)
        left.append(i[good])
        right.append(j[good])
    for k in np.flatnonzero(sizes > SMALL):
        a, b = starts[k], starts[k] + sizes[k]
        ends = a + np.searchsorted(root[a:b], root[a:b], side="right")  # rows of a run are sorted by root
        for i in range(a, b):
            j = np.arange(ends[i - a], b)
            if cross[i]:
                j = j[tile[j] != tile[i]]
            j = j[_room(own, n, i, j)] if len(j) else j
            left.append(np.full(len(j), i))
            right.append(j)
    empty = np.empty(0, np.int64)
    i, j = (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty)
    first = ~_met(runs["least"], runs["h"], i, j)
    return i[first], j[first]


def _compared(mixed: DataFrame, round_: int = 0) -> DataFrame:
    """(a, b, weight): pairs of texts of a block, of different groups so far, whose sketches leave room for the similarity.

    With a round, only pairs with one text of each tile, chosen by that number, and ``weight`` is the
    number of the block's rows; without, all pairs, each only in the first of the blocks that it is known to share: all
    texts of a block are compared there, so none is lost. A task holds a batch and a pair of tiles at a time.
    """
    keys, numbers = ("h", "p", "q"), ("h", "p", "q", "tile", "rows", "node", "root", "n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def found(runs: dict[str, np.ndarray]) -> pa.RecordBatch:
            changed = np.zeros(len(runs["h"]), dtype=bool)
            changed[0] = True
            for c in keys:
                changed[1:] |= runs[c][1:] != runs[c][:-1]
            i, j = _pairs_of(runs, np.flatnonzero(changed), round_)
            return pa.RecordBatch.from_arrays([pa.array(runs["node"][i]), pa.array(runs["node"][j]), pa.array(runs["rows"][i])], ["a", "b", "weight"])

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = {c: np.asarray(batch.column(c)).astype(np.int64) for c in numbers}
            runs["sketch"] = counts(batch.column("sketch").to_pylist())
            if not round_:
                runs["least"] = np.asarray(batch.column("least").flatten()).reshape(-1, LEAST)
            if held:
                runs = {c: np.concatenate([held[c], runs[c]]) for c in runs}
            last = np.ones(len(runs["h"]), dtype=bool)
            for c in keys:
                last &= runs[c] == runs[c][-1]
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield found({c: x[:cut] for c, x in runs.items()})
            held = {c: x[cut:] for c, x in runs.items()}
        if held:
            yield found(held)

    return _tiles(mixed, not round_).mapInArrow(work, "a long, b long, weight long")


def _linked(texts: DataFrame, blocks: DataFrame, first: list[DataFrame]) -> DataFrame:
    """(node, root) of every text that is alike to another one; ``first`` are pairs to verify beside those of the blocks' heads.

    Each text is held against the head of each of its blocks, in further rounds against another,
    as long as the blocks of several groups would still give many likely pairs; then all likely pairs of different
    groups are verified. So a large group of near copies does not make all of its pairs.
    """
    pairs = blocks.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    for more in first:
        pairs = pairs.union(more)
    pairs = stored(pairs.distinct(), "pairs")
    links = _verified(texts, _likely(texts, pairs))
    release(pairs)
    before = None
    for round_ in range(1, ROUNDS + 1):
        roots = connected_components(links)
        mixed = _mixed(blocks if before is None else before, roots, texts, before is not None)
        if before is not None:
            release(before)
        before = mixed
        met = stored(_compared(mixed, round_), "met")
        # what the chosen texts have of likely pairs tells how many there are in all
        expected, size = met.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0] / 2, mixed.count()
        last = expected <= PAIRS_PER_ROW * size or round_ == ROUNDS
        likely = _compared(mixed) if last else met
        found = _verified(texts, stored(likely.select("a", "b").distinct(), "likely"))
        joined = stored(links.union(found).distinct(), "links")
        release(links, found, met)
        links = joined
        if last:
            break
    release(before)
    return connected_components(links)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprints: bool = True) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, keeps) of every row; ``key`` is xxhash64 of the text.

    ``keeps`` is true for the rows of the group's smallest (doc_id, key).

    ``component_id`` is the smallest doc_id reachable over pairs of texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more. With ``fingerprints``, pairs that
    the SimHash operator's pigeonhole blocks find at two bits are verified first; but of texts at 0.8
    most fingerprints differ in 3 to 14 bits, where such blocks no longer tell them apart from
    others. So no pair is missed, blocks of a partition of the universe of shingles go on (``partition``):
    sets that are alike share a signature, and what shares one is compared in full. Texts of the same words meet
    as one, those without words too. Nulls and repeats are as in ``simhash``.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("text"))
    prints = _hashed(keyed)
    row = F.struct("doc_id", "key")
    first = stored(prints.groupBy("who").agg(F.min(row).alias("first"), F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("rep"), F.count("*").alias("n")), "first")
    named = spread_join(prints, first.select("who", "first"), ["who"], ["doc_id", "key"], counts=first)
    copies = named.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))))
    copies = stored(copies.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "copies")
    on = (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    # where the copies are few, no text is shuffled
    alone = keyed.join(F.broadcast(copies) if copies.count() <= BROADCAST_KEYS else copies, on, "left_anti")
    texts = _texts(alone)
    release(copies)
    similarity = partition.Similarity(PART, WHOLE)
    found = partition.blocks(texts, shingle_hashes, similarity, _common(texts), TEXT_BYTES)
    seeds = [_simhash_pairs(texts)] if fingerprints else []
    roots = _linked(texts, found, seeds)
    # an equal row may have been taken twice: its texts have the same shingles and are linked, so either will do
    nodes = texts.groupBy("who").agg(F.min_by("node", "node").alias("node"), F.max("n").alias("n_shingles"))
    reps = first.select("who", "rep").join(nodes, "who").join(roots, "node", "left").select("who", "n_shingles", "rep", F.coalesce("root", "node").alias("root"))
    reps = stored(reps, "reps")
    least = reps.groupBy("root").agg(F.min("rep").alias("least"))
    of = stored(reps.join(least, "root").select("who", "n_shingles", "least"), "groups")
    keeps = F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("key") == F.col("least.key")), F.lit(False))
    out = spread_join(prints, of, ["who"], ["doc_id", "key"], counts=first)
    out = stored(out.select("doc_id", "key", "n_shingles", F.col("least.doc_id").alias("component_id"), keeps.alias("keeps")), "near_duplicates")
    release(prints, first, texts, found, *seeds, reps, of)
    return out
