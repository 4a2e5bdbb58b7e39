"""SimHash near-duplicate detection by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, extended, refuse, spread_join, stored, utf8
from tidelog.llm.components import connected_components


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text, as a signed integer.

    A-Z are lower-cased, words are runs without ASCII white space, features are shingles of
    ``width`` words with repeats (a shorter text is one shingle; none gives 0).
    """
    words = text.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        hashes = [digest(join(words), seed)]
    else:
        hashes = [digest(join(s), seed) for s in zip(*(words[i:] for i in range(width)))]
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):  # memory stays bounded on very long texts
        bits = np.unpackbits(np.array(hashes[start : start + (1 << 16)], dtype="<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """``keep`` columns (none of them called ``fp``) and ``fp`` (long) of each row. A null text counts as empty: fp 0."""
    refuse(keep, "fp")
    kept = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([fingerprint(x, width) for x in utf8(batch.column("__text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], [*keep, "fp"])

    return kept.mapInArrow(work, extended(kept.drop("__text"), fp=T.LongType()))


def _kept_bits(blocks: int, kept: tuple[int, ...]) -> int:
    """Mask of the bits of the blocks named; blocks are runs of 64 // blocks bits or one more."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in kept)
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(fps: DataFrame, distance: int = 2, blocks: int = 6) -> DataFrame:
    """(a, b), a < b: the pairs of distinct ``fp`` values that differ in 1 to ``distance`` bits.

    Of ``blocks`` blocks, a pair within ``distance`` bits agrees on ``blocks - distance`` at
    least, so each choice of that many blocks is one key. Six blocks give keys of 42 bits
    or so: they stay selective for 10^10 documents, and a group of like documents is spread
    over many of them. The join verifies the whole distance.
    """
    if not 0 < distance < blocks <= 64:
        raise ValueError("need 0 < distance < blocks <= 64")
    masks = [_kept_bits(blocks, k) for k in combinations(range(blocks), blocks - distance)]
    keyed = fps.select("fp").distinct().select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(i).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("block"))
                    for i, m in enumerate(masks)
                )
            )
        ).alias("k"),
    ).select("k.choice", "k.block", "fp")
    # many fingerprints may share a block, so each block's rows are spread over tasks
    keyed = stored(keyed, "blocks")
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return spread_join(left, right, ["choice", "block"], ["a"]).where(near).select("a", "b").distinct()


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, blocks: int = 6, width: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every row.

    ``component_id`` is the smallest doc_id reachable over links between fingerprints that
    differ in ``distance`` bits or fewer; ``n_links`` counts the other fingerprints linked.
    Exact copies share a fingerprint and meet only as one row each, so no pair of copies is
    made. Null and empty texts have fingerprint 0 and link like any other. Repeated doc_ids
    give a row each; a null doc_id never is a component's id unless all its doc_ids are null.
    """
    prints = durable(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width))
    reps = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    links = durable(near_pairs(reps, distance, blocks))
    roots = connected_components(links)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    )
    linked = (
        reps.join(roots, reps.fp == roots.node)
        .groupBy("root")
        .agg(F.min("rep").alias("component_id"))
        .join(roots, "root")
        .join(degree, "node")
        .select(F.col("node").alias("fp"), "component_id", "n_links")
    )
    classes = reps.join(linked, "fp", "left").select(
        "fp",
        "n",
        F.coalesce("component_id", "rep").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
    # copies of a fingerprint may be a third of all rows
    classes = durable(classes)
    return spread_join(prints, classes.drop("n"), ["fp"], ["doc_id"], counts=classes.select("fp", "n")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "n_links")
