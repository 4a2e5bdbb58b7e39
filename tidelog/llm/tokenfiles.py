"""Token-id files of directly addressable codes: any token can be read without decoding a block."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import kept_by_worker, pieces, stored, utf8

#: Bits of a code chunk, bits between entries of a rank directory, and tokens of a file row.
CHUNK_BITS, RANK_STEP, SHARD_TOKENS = 8, 512, 1 << 16
#: Parts of texts, and normalised words, whose ids a Python worker keeps.
CACHE_PARTS, CACHE_WORDS = 600_000, 400_000
#: Bytes of text that are held split up, and words that the library encodes in one text.
TEXT_BYTES, WORDS_AT_ONCE = 4 << 20, 256
_MAGIC = b"DAC1"

# How a tokenizers file normalises and splits texts, if words may be looked up one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
#: The same split where all characters are of _PLAIN, which composition leaves alone and whose lower case is of it too.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ‐-‧]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


def pack(ids: np.ndarray) -> bytes:
    """Ids as levels of 8-bit chunks, low bits first.

    A level holds a chunk of every id that reaches it, a bitmap that says which of them goes on
    in the next level, and the number of ones before each RANK_STEP bits of it.
    """
    left = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = left >> CHUNK_BITS > 0
        bitmap = np.packbits(more, bitorder="little")
        padded = np.pad(more, (0, -len(more) % RANK_STEP)).reshape(-1, RANK_STEP).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(padded)]).astype("<u4")
        levels.append(struct.pack("<QI", len(left), len(ranks)) + ranks.tobytes() + bitmap.tobytes() + (left & 255).astype(np.uint8).tobytes())
        left = left[more] >> CHUNK_BITS
        if not len(left):
            break
    return _MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (n_levels,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for _ in range(n_levels):
            n, n_ranks = struct.unpack_from("<QI", data, at)
            ranks = np.frombuffer(data, dtype="<u4", count=n_ranks, offset=at + 12)
            at += 12 + 4 * n_ranks
            bitmap = np.frombuffer(data, dtype=np.uint8, count=-(-n // 8), offset=at)
            at += len(bitmap)
            self.levels.append((ranks, bitmap, np.frombuffer(data, dtype=np.uint8, count=n, offset=at)))
            at += n
        self.size = len(self.levels[0][2])

    def _rank(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before place ``i``."""
        ranks, bitmap, _ = self.levels[level]
        block = i // RANK_STEP
        start = block * RANK_STEP
        bits = np.unpackbits(bitmap[start // 8 : -(-i // 8)], bitorder="little", count=i - start) if i > start else ()
        return int(ranks[block]) + int(np.sum(bits, dtype=np.int64))

    def get(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, (_, bitmap, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("the last level goes on")

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``; of each level only the range that they need is read."""
        if not 0 <= start <= stop <= self.size:
            raise IndexError((start, stop))
        out = np.zeros(stop - start, dtype=np.uint32)
        places = np.arange(stop - start)
        for level, (_, bitmap, chunks) in enumerate(self.levels):
            if start == stop:
                break
            out[places] |= chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            first = start // 8 * 8
            more = np.unpackbits(bitmap[first // 8 : -(-stop // 8)], bitorder="little")[start - first : stop - first].astype(bool)
            places = places[more]
            start = self._rank(level, start)
            stop = start + len(places)
        return out


class Tokenizer:
    """A tokenizers file.

    Where the file drops white space, lower-cases and splits as NORMALIZER and SPLIT say, no
    token crosses ASCII white space, so texts are looked up part by part, and unseen parts word
    by word as they are normalised. The library encodes the words, many at a time: the last
    token of each ends a word. It encodes parts whole that hold other characters or may hold a
    special token. By another file it encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        splits = (form["pre_tokenizer"] or {}).get("pretokenizers") or [None]
        self.special = [x["content"] for x in form["added_tokens"]]
        self.by_part = (
            form["normalizer"] == NORMALIZER
            and splits[0] == SPLIT
            and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in splits[1:])
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in form["added_tokens"])
            and not any(re.search(r"\s", x) for x in self.special)
        )
        end = form["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for x, i in vocabulary.items() if end and x.endswith(end)]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _many(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from one text of them all."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):  # a word without an end: one by one
            return [self._whole(x) for x in words]
        return [ids[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _unseen(self, parts: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        split: dict[bytes, list[str]] = {}
        for part in parts:
            text = part.decode()
            if _PLAIN.fullmatch(text) and not any(x in text for x in self.special):
                split[part] = _WORDS.findall(text.lower())
            else:
                out[part] = self._whole(text)
        new = list(set(chain.from_iterable(split.values())).difference(self.words))
        fresh: dict[str, bytes] = {}
        for k in range(0, len(new), WORDS_AT_ONCE):
            fresh.update(zip(new[k : k + WORDS_AT_ONCE], self._many(new[k : k + WORDS_AT_ONCE])))
        for part, words in split.items():
            out[part] = b"".join([self.words.get(w) or fresh[w] for w in words])
        self.words.update(islice(fresh.items(), max(0, CACHE_WORDS - len(self.words))))
        return out

    def encode(self, docs: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers, without special tokens added."""
        if not self.by_part:
            return [self._whole(x.decode()) for x in docs]
        rows = [x.split() for x in docs]
        found = [list(map(self.parts.get, row)) for row in rows]
        late = [i for i, ids in enumerate(found) if None in ids]
        unseen = {x for i in late for x, ids in zip(rows[i], found[i]) if ids is None}
        fresh = self._unseen(list(unseen))
        for i in late:
            found[i] = [fresh[x] if ids is None else ids for x, ids in zip(rows[i], found[i])]
        self.parts.update(islice(fresh.items(), max(0, CACHE_PARTS - len(self.parts))))
        return list(map(b"".join, found))


_SHARD = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("shard_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("codes", T.BinaryType()),
    ]
)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", name: str = "tokens") -> DataFrame:
    """Write all ids in ascending order of ``doc_id`` to the shared folder, and return the file's rows.

    Documents are dealt out by ranges of (doc_id, hash of the text), so not even one id of very
    many rows meets in one task, and sorted in each. A row of the file holds whole documents, up
    to SHARD_TOKENS tokens (or one longer document): its place in the order (``part``,
    ``shard``), ids of the part before it, the documents' ids and token counts, and the packed
    ids. The file is Parquet without compression; ``tokens_at`` and ``slice_at`` find the rows of
    any place by ``directory`` and read single codes of them. ``end_id`` is appended to each document. Null ids come first, rows of one id in order of a hash of their
    text; a null text is empty.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        shard, before, ids, held, size = 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            codes = pack(np.frombuffer(b"".join(held), dtype="<u4"))
            lengths = [len(x) // 4 for x in held]
            values = [[part], [shard], [before], [size], [ids], [lengths], [codes]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], _SHARD.names)

        for batch in pieces(batches, "text", TEXT_BYTES):
            tokenizer = kept_by_worker(("tokenizer", tokenizer_path), lambda: Tokenizer(tokenizer_path))
            for i, x in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(utf8(batch.column("text")))):
                n = len(x) // 4 + 1
                if held and size + n > SHARD_TOKENS:
                    yield row()
                    shard, before, ids, held, size = shard + 1, before + size, [], [], 0
                ids.append(i)
                held.append(x + end)
                size += n
        if held:
            yield row()

    return stored(ordered.mapInArrow(work, _SHARD), name, compression="none")


def _bases(file: DataFrame) -> DataFrame:
    """(part, base): ids before each part; a row for each task of the writer, so it is broadcast."""
    totals = file.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return F.broadcast(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))


def directory(file: DataFrame) -> DataFrame:
    """(part, shard, start, n_tokens): the place of each row of the file among all ids; codes are not read."""
    start = (F.col("base") + F.col("shard_start")).alias("start")
    return file.select("part", "shard", "shard_start", "n_tokens").join(_bases(file), "part").select("part", "shard", start, "n_tokens")


def tokens_at(file: DataFrame, positions: DataFrame, position: str = "position") -> DataFrame:
    """(position, token): the id at each distinct place that ``positions`` names, counted over the whole file.

    Places outside the file and nulls give no row. A place meets the row of the file that holds
    it by its stretch of SHARD_TOKENS ids; the places of one stretch, so many at most, are taken
    from its codes one by one.
    """
    step = F.lit(SHARD_TOKENS)
    stretch = lambda x: F.floor(x / step)
    last = F.col("start") + F.col("n_tokens") - 1
    rows = directory(file).withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(last))))
    wanted = positions.select(F.col(position).cast("long").alias("at")).where("at IS NOT NULL").distinct()
    found = wanted.withColumn("stretch", stretch(F.col("at"))).join(rows, "stretch").where("at >= start AND at < start + n_tokens")
    groups = found.groupBy("part", "shard", "stretch").agg(F.min("start").alias("start"), F.collect_list("at").alias("places"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = Codes(r["codes"])
                ids = [codes.get(p - r["start"]) for p in r["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["places"], pa.int64()), pa.array(ids, pa.int64())], ["position", "token"])

    held = groups.join(file.select("part", "shard", "codes"), ["part", "shard"])
    return held.select("start", "places", "codes").mapInArrow(work, "position long, token long")


def slice_at(file: DataFrame, start: int, stop: int) -> DataFrame:
    """(position, ids): the ids from place ``start`` to ``stop`` of the whole file, in pieces; each begins at ``position``.

    Only rows that hold some of them are opened, and of each level of their codes only the range needed.
    """
    if not 0 <= start <= stop:
        raise ValueError("need 0 <= start <= stop")
    rows = directory(file).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes, first = Codes(r["codes"]), max(start, r["start"])
                ids = codes.slice(first - r["start"], min(stop - r["start"], codes.size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["position", "ids"])

    held = rows.join(file.select("part", "shard", "codes"), ["part", "shard"]).select("start", "codes")
    return held.mapInArrow(work, "position long, ids array<long>")


def read(file: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the file's codes.

    ``start`` counts the ids of all documents before it. Only one number per part, so at most
    one per task of the writer, is broadcast.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes, at, out = Codes(r["codes"]), 0, []
                ids = codes.slice(0, codes.size).astype("<u4", copy=False)  # all of them are wanted
                for n in r["lengths"]:
                    out.append((r["shard_start"] + at, n, zlib.crc32(ids[at : at + n])))
                    at += n
                columns = [[r["part"]] * len(out), r["doc_ids"], *(list(c) for c in zip(*out))]
                kinds = [pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "doc_id", "offset", "n_tokens", "ids_crc32"]
                )

    found = file.select("part", "shard_start", "doc_ids", "lengths", "codes").mapInArrow(
        work, "part int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return found.join(_bases(file), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
