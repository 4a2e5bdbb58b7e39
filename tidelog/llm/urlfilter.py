"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bitmap, durable, in_bitmap, refuse, spread_join

#: Bits per listed URL, bits of a block (8 words of 32), and bytes of the filter at most.
BITS_PER_KEY, BLOCK_BITS, FILTER_BYTES = 12, 256, 64 << 20
#: Bits of the map of listed hosts, and of path lengths by host, at most (4 MB).
HOST_BITS = 1 << 25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?`` or ``#``.

    Both are empty for a null url and one without ``://``.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise("")
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.substr(rest, F.length(host) + 1, F.length(rest) + 1)


def _key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\n"), path)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks))


def _bits(h: Column) -> list[Column]:
    """One bit in each of the block's eight 32-bit words, from a second hash."""
    g = F.xxhash64(h, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 5 * i).bitwiseAND(31).cast("int")) for i in range(8)]


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """Blocks (``block``, ``b0`` ... ``b7``) of the filter of column ``h``, and how many there can be.

    The number of blocks follows the number of keys, up to FILTER_BYTES in all: beyond it only
    more URLs pass on to the exact join.
    """
    blocks = max(1, min(n_keys * BITS_PER_KEY // BLOCK_BITS + 1, FILTER_BYTES * 8 // BLOCK_BITS))
    parts = keys.select(_block(F.col("h"), blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("h")))))
    return parts.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(8))), blocks


def judge(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of each row of ``pages``.

    ``rules`` has (host, path, verdict), canonical: a lower-case host, and a path as in a url.
    A rule fits its host and all subdomains if the url's path starts with the rule's; of the
    rules that fit, the longest (host and path, then host) wins, of equal ones the smallest
    verdict. ``rule`` is its host and path; where none fits it is null and the verdict is
    ``default``: what is not listed. Rules with a null part are ignored.

    Each distinct host and path is judged once, then joined back, spread where many pages have
    it. Of a host's suffixes those go on that a bitmap of listed hosts may hold, and of the
    path's prefixes those of lengths that it may hold for that suffix; so a long list of many
    lengths does not multiply the pages. They are held against the filter, whose size is bounded
    and so is broadcast; those that pass meet the list in an ordinary join by key, so the list
    may have any size. ``keep`` may not name a result.
    """
    refuse(keep, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url))
    rows = pages.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), host.alias("host"), path.alias("path"))
    listed = durable(
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("h", _key_hash(F.col("host"), F.col("path")))
    )
    shape = listed.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    n, labels, lengths = shape.agg(F.count("*"), F.collect_set("labels"), F.collect_set("length")).first()
    of_length = lambda s, k: F.xxhash64(s, k.cast("int"))
    hosts = listed.select(F.explode(F.array(F.xxhash64("host"), of_length("host", F.length("path")))).alias("h"))
    known, bits = bitmap(hosts, "h", 2 * n, HOST_BITS)
    judged = durable(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.lit(sorted(labels)).cast("array<int>"), lambda k: k <= F.size(parts)),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    prefixes = F.filter(F.lit(sorted(lengths)).cast("array<int>"), lambda k: k <= F.length("path"))
    candidates = (
        judged.select("host", "path", F.explode(suffixes).alias("s"))
        .where(in_bitmap(known, bits, F.xxhash64("s")))
        .select("host", "path", "s", F.explode(prefixes).alias("k"))
        .where(in_bitmap(known, bits, of_length("s", F.col("k"))))
        .select("host", "path", "s", F.substring(F.col("path"), F.lit(1), F.col("k")).alias("p"))
        .withColumn("h", _key_hash(F.col("s"), F.col("p")))
    )
    blocks, n_blocks = build_filter(listed, n)
    passed = F.lit(True)
    for i, bit in enumerate(_bits(F.col("h"))):
        passed = passed & (F.col(f"b{i}").bitwiseAND(bit) == bit)
    possible = (
        candidates.withColumn("block", _block(F.col("h"), n_blocks)).join(F.broadcast(blocks), "block").where(passed).select("host", "path", "s", "p")
    )
    rule = F.struct((F.length("s") + F.length("p")).alias("length"), F.length("s").alias("host_length"), F.concat("s", "p").alias("rule"), "verdict")
    exact = listed.select(F.col("host").alias("s"), F.col("path").alias("p"), "verdict")
    best = durable(possible.join(exact, ["s", "p"]).groupBy("host", "path").agg(F.max(rule).alias("best")))
    by = [f"__{i}" for i in range(len(keep))] or ["host"]
    return spread_join(rows, best, ["host", "path"], by, how="left", counts=judged).select(
        *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
