"""Candidate blocks of an exact Jaccard join: a partition of the universe of tokens, with one-deletion neighbourhoods.

Sizes are cut into bands. In the scheme of a band, tokens (64-bit hashes) are dealt out to segments.
Of two sets whose smaller one is of the band, at most ``H`` tokens are not shared, where ``H`` follows from the
smaller size; so if a set gives its segments budgets that sum up to ``H + 1``, then in some segment the
other set differs by less than the budget: not at all for a budget of one, by one token at most for
two. Every set indexes the subset that each segment holds of it, and for a few segments also that subset with each of
its tokens left out; the smaller set looks up its subsets where it has a budget. Budgets are
dealt out by cost: segments that hold nothing or only common tokens get none where others can make up for
them. How many segments there are and which are indexed by deletions depends on the band alone, so no choice that a
set makes can hide a pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import pieces, stored, utf8

#: What a row of a signature is: the subset of a set that can be found, or one that is looked for; a row known to have
#: company; a row that needs not meet the others of its signature, since they are known to be there.
FOUND, LOOKS, KNOWN, AWAY = 1, 2, 4, 8
ROLE_BITS = 4
#: The sign of a row that looks or is known: such rows come first among those of a signature.
FIRST = np.int64(-1 << 63)
#: Signatures that a task gathers before it hands them on, and from how many rows on one of them is known by the task.
GATHERED, MANY = 1 << 20, 64
#: A token's count in the sample from which on a segment of such tokens is dear, and what an empty segment costs.
DEAR, EMPTY = 8, 1 << 30
#: Tasks over which the rows of a signature are dealt out that are known to have company.
SPREAD = 4096

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers: each bit of the argument bears on all of the result."""
    x = (x ^ (x >> _S33)) * _C1
    x = (x ^ (x >> _S33)) * _C2
    return x ^ (x >> _S33)


class Similarity:
    """A least Jaccard similarity part / whole, in whole numbers."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def largest(self, n: int) -> int:
        """The size of the largest set that can be similar to one of ``n``."""
        return n * self.whole // self.part

    def differ(self, n: int) -> int:
        """Tokens that a set of ``n`` and a larger one that is similar do not share, at most."""
        return (n + self.largest(n)) * (self.whole - self.part) // (self.whole + self.part)


@lru_cache(maxsize=None)
def bands(part: int, whole: int) -> tuple[tuple[int, int], ...]:
    """First and last size of each band; bands are half as wide again as they begin."""
    out, low = [], 1
    while low < 1 << 31:
        high = max(low, low * 3 // 2)
        out.append((low, high))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=None)
def scheme(part: int, whole: int, band: int) -> tuple[int, int, np.ndarray]:
    """(segments, how many of them are indexed by deletions, a number for each segment) of a band."""
    least = Similarity(part, whole).differ(bands(part, whole)[band][1]) + 1
    segments = least + least // 64 + (least >= 8)
    at = np.arange(segments, dtype=np.uint64) + np.uint64(1)
    return segments, segments // 32 + (segments >= 8), mix(at * _C1 + np.full(segments, band + 1, np.uint64) * _C2)


def budgets(need: int, size: np.ndarray, cost: np.ndarray, second: np.ndarray, flexible: int) -> np.ndarray:
    """0, 1 or 2 for each segment, ``need`` in all. ``cost`` is that of a budget of one, ``second`` what two cost beside it."""
    v = np.ones(len(size), dtype=np.int64)
    spare = len(size) - need
    dearest = np.argsort(-cost, kind="stable")
    v[dearest[:spare]] = 0
    for at in dearest[spare : spare + flexible]:
        if cost[at] < DEAR:
            break
        if v[at] == 2:
            continue
        open_ = [i for i in range(flexible) if v[i] == 1 and i != at and size[i] > 1 and second[i] < cost[at]]
        if not open_:
            break
        v[min(open_, key=lambda i: second[i])] = 2
        v[at] = 0
    return v


def signatures(tokens: np.ndarray, similarity: Similarity, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, role) rows of a set of sorted distinct 64-bit hashes; ``counts`` tells how common each is."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    every = bands(similarity.part, similarity.whole)
    own = first = bisect_left(every, n, key=lambda band: band[1])
    while first and similarity.largest(every[first - 1][1]) >= n:
        first -= 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(tokens, out=sums[1:])
    place = tokens >> np.uint64(32)
    common = counts is not None and counts.any()
    keys, roles = [], []
    for band in range(first, own + 1):
        segments, flexible, salt = scheme(similarity.part, similarity.whole, band)
        # tokens are sorted, so a segment is a run of them
        segment = ((place * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
        size = np.bincount(segment, minlength=segments)
        ends = size.cumsum()
        upto = sums[ends]
        total = upto.copy()
        total[1:] -= upto[:-1]
        key = mix(total + salt)
        role = np.full(segments, FOUND)
        without = total[segment[: ends[flexible - 1]]] - tokens[: ends[flexible - 1]] if flexible else np.empty(0, np.uint64)
        of = segment[: len(without)]
        left = size[of] > 2  # what would be left of fewer is looked for by no budget of two
        keys.append(mix((without[left] + salt[of[left]]) ^ _C1))
        roles.append(np.full(int(left.sum()), FOUND))
        if band == own:
            cost, second = np.where(size == 0, EMPTY, 4 // np.maximum(size, 1)), size
            if common:
                filled = np.flatnonzero(size)
                least = np.minimum.reduceat(counts, ends[filled] - size[filled])
                cost[filled] += least * DEAR
                second = second.copy()
                second[filled] += least * DEAR * size[filled]
            v = budgets(similarity.differ(n) + 1, size, cost, second, flexible)
            role[v > 0] |= LOOKS
            for i in np.flatnonzero(v == 2):
                of_i = np.arange(ends[i] - size[i], ends[i])
                looked = np.concatenate([mix(total[i] - tokens[of_i] + salt[i]), mix((total[i : i + 1] + salt[i]) ^ _C1)])
                keys.append(looked)
                roles.append(np.full(len(looked), LOOKS))
        keys.append(key)
        roles.append(role)
    return np.concatenate(keys), np.concatenate(roles)


def _node(who: np.ndarray) -> np.ndarray:
    return (who & ~FIRST) >> ROLE_BITS


def _handed_on(keys: list, marks: list) -> pa.RecordBatch:
    """Signature rows; those of a signature that a task has often need not meet the rest, but for one that stands for them."""
    h, who = np.concatenate(keys).view(np.int64), np.concatenate(marks)
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(starts, append=len(h))
    extra = []
    for k in np.flatnonzero(sizes >= MANY):
        run = slice(starts[k], starts[k] + sizes[k])
        if (who[run] & LOOKS).any() and len(np.unique(who[run] >> ROLE_BITS)) > 1:
            extra.append((h[starts[k]], who[starts[k]] | KNOWN))
            who[run] |= KNOWN | AWAY
    if extra:
        h = np.concatenate([h, np.array([x[0] for x in extra], np.int64)])
        who = np.concatenate([who, np.array([x[1] for x in extra], np.int64)])
    who[who & (LOOKS | KNOWN) > 0] |= FIRST
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(who)], ["h", "who"])


def _runs(h: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    """(h, node, head) of the signatures that have company: one that looks or is known stands first, and there are two nodes."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(starts, append=len(h))
    node = _node(who)
    several = np.minimum.reduceat(node, starts) != np.maximum.reduceat(node, starts)
    good = (who[starts] < 0) & (several | (np.bitwise_or.reduceat(who & KNOWN, starts) > 0))
    keep, head = np.repeat(good, sizes), np.repeat(node[starts], sizes)
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, node, head)], ["h", "node", "head"])


def _with_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of rows sorted by (h, who). Of a run that goes on from batch to batch, a bounded number of rows is held."""
    h, who = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.concatenate([h, batch.column("h").to_numpy()])
        who = np.concatenate([who, batch.column("who").to_numpy()])
        last = int(np.searchsorted(h, h[-1]))
        if last:
            yield _runs(h[:last], who[:last])
            h, who = h[last:], who[last:]
        elif len(h) > GATHERED:  # its first row tells whether any row looks; it stays, so that what follows has company
            if who[0] < 0:
                who[0] |= KNOWN
                yield _runs(h, who)
            h, who = h[:1], who[:1]
    if len(h):
        yield _runs(h, who)


def blocks(texts: DataFrame, tokens, similarity: Similarity, common: tuple[np.ndarray, np.ndarray], text_bytes: int) -> DataFrame:
    """(h, node, head): sets that share a signature ``h``, one of them looking for it, and one of them as their head.

    ``tokens`` makes the sorted hashes of a text; ``common`` lists hashes and how often a sample has them. One shuffle
    by signature, sorted within, so no task holds a signature's sets.
    """
    listed = texts.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = listed.value[0].view(np.uint64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], listed.value[1][order]
        keys, marks, size = [], [], 0
        for batch in pieces(batches, "text", text_bytes):
            for node, text in zip(batch.column("node").to_pylist(), utf8(batch.column("text"))):
                own = tokens(text).view(np.uint64)
                own.sort()
                seen = None
                if len(hashes) and len(own):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    seen = np.where(hashes[at] == own, counts[at], 0)
                h, role = signatures(own, similarity, seen)
                keys.append(h)
                marks.append((node << ROLE_BITS) + role)
                size += len(h)
                if size > GATHERED:
                    yield _handed_on(keys, marks)
                    keys, marks, size = [], [], 0
        if size:
            yield _handed_on(keys, marks)

    rows = texts.select("node", "text").mapInArrow(work, "h long, who long")
    away = F.col("who").bitwiseAND(AWAY) > 0
    dealt = rows.repartition(F.col("h").bitwiseXOR(F.when(away, F.pmod(F.xxhash64("who"), F.lit(SPREAD))).otherwise(F.lit(0))))
    return stored(dealt.sortWithinPartitions("h", "who").mapInArrow(_with_company, "h long, node long, head long"), "blocks")
