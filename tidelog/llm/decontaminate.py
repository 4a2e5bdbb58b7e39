"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bitmap, durable, in_bitmap

#: 1: the word counts; 0: any word may stand there. Of 10 to 16 words, and any places that SIMILARITY lets be
#: substituted, one of these finds five that agree; the tests go through all of them.
MASKS = ("111101", "1100111", "10010111")
#: Items of fewer words have masks of their own: all words, or from five words on all but one.
LEAST_WORDS = 10
#: Words compared around a hit, and the share of them that must agree.
WINDOW, SIMILARITY = 16, 0.8
#: Window starts that share one piece of a document, and bytes up to which seeds are broadcast.
PIECE, BROADCAST_BYTES = 64, 32 << 20
#: Beyond that, tasks that share the windows of one seed at least.
SALTS = 16
#: Bits of the map that windows are held against before the join, at most (8 MB).
BITMAP_BITS = 1 << 26


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def short_masks(n_words: int) -> list[str]:
    """The masks of an item of fewer than LEAST_WORDS words: where 0.8 lets no word be substituted, all; else all but one."""
    whole = "1" * n_words
    if n_words < 5:
        return [whole]
    return sorted({(whole[:i] + "0" + whole[i + 1 :]).strip("0") for i in range(n_words)})


def _windows(df: DataFrame, h: str, keep: list[str], masks: tuple[str, ...], margin: int) -> DataFrame:
    """One row per window start: ``keep``, ``pos``, the seed of each mask (``seed0`` ...) and ``ctx``.

    A seed is null where its mask runs over the end. Documents are cut in pieces of PIECE starts
    first; each row carries the words of its piece and ``margin`` words on both sides, never the
    whole document. ``ctx0`` is the position of the first of them.
    """
    starts, span = F.size(h) - min(map(len, masks)) + 1, max(map(len, masks))

    def piece(k: Column) -> Column:
        n, ctx0 = F.least(F.lit(PIECE), starts - k * PIECE), F.greatest(F.lit(0), k * PIECE - margin)
        ctx = F.slice(h, ctx0 + 1, k * PIECE - ctx0 + n + span + margin)
        return F.struct((k * PIECE).alias("p0"), n.alias("n"), ctx0.alias("ctx0"), ctx.alias("ctx"))

    cuts = F.when(starts > 0, F.sequence(F.lit(0), ((starts - 1) / PIECE).cast("int"))).otherwise(F.expr("array()"))
    rows = (
        df.select(*keep, F.explode(F.transform(cuts, piece)).alias("piece"))
        .select(*keep, "piece.*")
        .select(*keep, "p0", "ctx0", "ctx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    )
    first = F.col("p0") - F.col("ctx0") + F.col("at")
    seed = lambda mask: F.xxhash64(F.lit(mask), *(F.get("ctx", first + o) for o in _offsets(mask)))
    return rows.select(
        *keep,
        (F.col("p0") + F.col("at")).alias("pos"),
        *(F.when(first + len(mask) <= F.size("ctx"), seed(mask)).alias(f"seed{m}") for m, mask in enumerate(masks)),
        "ctx0",
        "ctx",
    )


def _by_seed(windows: DataFrame, n_masks: int) -> DataFrame:
    names = [f"seed{m}" for m in range(n_masks)]
    return windows.select(*(c for c in windows.columns if c not in names), F.explode(F.array(*names)).alias("seed"))


def _item_seeds(items: DataFrame, masks: tuple[str, ...], short: dict[int, list[str]], margin: int) -> DataFrame:
    """The seeds of each item by the masks of its length, with their spans."""
    every = (*masks, *sorted({x for xs in short.values() for x in xs} - set(masks)))
    windows = _windows(items, "h", ["item_id", "n_items", "m"], every, margin)
    own = {mask: F.col("m").isin(*(n for n, xs in short.items() if mask in xs)) for mask in every}
    own |= {mask: own[mask] | (F.col("m") >= LEAST_WORDS) for mask in masks}
    seeds = [
        F.when(own[mask] & F.col(f"seed{i}").isNotNull(), F.struct(F.col(f"seed{i}").alias("seed"), F.lit(len(mask)).alias("span")))
        for i, mask in enumerate(every)
    ]
    rows = windows.select("item_id", "n_items", "m", F.col("pos").alias("q"), F.col("ctx0").alias("ictx0"), F.col("ctx").alias("ictx"), F.explode(F.array(*seeds)).alias("s"))
    return rows.where("s IS NOT NULL").select("s.seed", "s.span", *(c for c in rows.columns if c != "s")), every


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, item_id, n_items, matched, compared, similarity, doc_pos) of every overlap.

    A document overlaps an item where ``window`` words of both, aligned, agree in ``similarity``
    of their places or more; of a shorter item all words are compared. Spaced seeds find them:
    words that a mask ignores may be substituted. With the default masks and limits no overlap
    is missed. One row for each document and item, with the best window; ``doc_pos`` is the
    first word of it in the document (negative where the item begins before it). Items of equal
    words count once: ``item_id`` is the smallest of their ids, ``n_items`` their number. Null
    and empty texts and items overlap nothing. Rows of one doc_id give one row for each item.

    Documents are never shuffled: their windows meet the seeds of the benchmark in a broadcast
    join as long as these take BROADCAST_BYTES or less, else in a shuffled join by seed, salted so
    that a phrase of very many documents is shared by SALTS tasks. A bitmap of bounded size drops
    most windows before, none that could hit.
    """
    if any(m[0] != "1" or m[-1] != "1" for m in masks):
        raise ValueError("masks need 1 at both ends")
    if not max(map(len, masks)) <= LEAST_WORDS <= window <= 32:
        raise ValueError(f"masks may span {LEAST_WORDS} words, and the window so many to 32")
    items = (
        benchmark.select(F.col(item_id).alias("item_id"), hashes(F.col(item_text)).alias("h"))
        .groupBy("h")
        .agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
        .withColumn("m", F.size("h"))
        .where("m > 0")
    )
    lengths = [r.m for r in items.where(F.col("m") < LEAST_WORDS).select("m").distinct().collect()]  # ten values at most
    seeds, masks = _item_seeds(items, masks, {n: short_masks(n) for n in sorted(lengths)}, window)
    least, span = min(map(len, masks)), max(map(len, masks))
    seeds = durable(seeds)
    n_seeds = seeds.count()
    known, bits = bitmap(seeds, "seed", n_seeds, BITMAP_BITS)
    base = docs.select(F.col(doc_id).alias("doc_id"), hashes(F.col(text)).alias("h"))
    windows = _windows(base, "h", ["doc_id"], masks, window)

    # The test stands behind the explode, on ``seed`` itself: in front of it, it would be pushed
    # down with the hash of every mask written out twice, and these made anew for each use.
    likely = in_bitmap(known, bits, F.col("seed"))
    possible = _by_seed(windows, len(masks)).where(likely)
    if n_seeds * (20 + 8 * (PIECE + span + 2 * window)) <= BROADCAST_BYTES:  # bytes of a row: some 100 words of 8
        hits = possible.join(F.broadcast(seeds), "seed")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = possible.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])

    # All windows of the item that hold the hit's words: bit j of ``agree`` says whether the words
    # at ``lowest`` + j agree, so each window is a count of bits.
    size = F.least(F.lit(window), F.col("m"))
    lowest = F.greatest(F.lit(0), F.col("q") + F.col("span") - size)
    highest = F.least(F.col("q"), F.col("m") - size)
    at = F.col("pos") - F.col("q") + F.col("lowest")
    agree = F.aggregate(
        F.sequence(F.lit(0), F.col("highest") - F.col("lowest") + F.col("size") - 1),
        F.lit(0).cast("long"),
        lambda bits, j: F.when(
            F.get(F.col("ctx"), at + j - F.col("ctx0")) == F.get(F.col("ictx"), F.col("lowest") + j - F.col("ictx0")),
            bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)),
        ).otherwise(bits),
    )
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("size")) - 1
    counts = F.array(
        *(
            F.when(
                F.col("highest") - F.col("lowest") >= s,
                F.struct(
                    F.bit_count(F.shiftright("agree", s).bitwiseAND(whole)).alias("matched"), (-(at + s)).alias("back")
                ),
            )
            for s in range(window - least + 1)
        )
    )
    found = (
        hits.where(highest >= lowest)
        .withColumns({"size": size, "lowest": lowest, "highest": highest})
        .withColumn("agree", agree)
        .select("doc_id", "item_id", "n_items", F.col("size").alias("compared"), F.array_max(counts).alias("best"))
    )
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max("n_items").alias("n_items"), F.max("compared").alias("compared"), F.max("best").alias("best"))
        .where(F.col("best.matched") >= F.ceil(F.col("compared") * F.lit(float(similarity)) - F.lit(1e-9)))
        .select(
            "doc_id",
            "item_id",
            "n_items",
            F.col("best.matched").alias("matched"),
            "compared",
            (F.col("best.matched") / F.col("compared")).alias("similarity"),
            (-F.col("best.back")).alias("doc_pos"),
        )
    )
