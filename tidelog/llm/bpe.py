"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark partitions."""

from __future__ import annotations

import base64
import gc
import os
import tempfile
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import extended, give_back, kept_by_worker, pieces, refuse, texts

#: Words and parts of texts kept from batch to batch, and tokens in all rows that one recursive query makes at most.
CACHE_WORDS, CACHE_PARTS, QUERY_ROWS = 300_000, 100_000, 1_500_000
#: Words above this many bytes are encoded in pieces of so many bytes (a power of two), and bytes on both sides of a
#: seam that are encoded anew where two pieces do not fit.
LONG_WORD, PIECE, SEAM = 512, 256, 32
#: Bytes of text, and tokens, that are held at a time.
TEXT_BYTES, DECODE_TOKENS = 3 << 19, 100_000

# Patterns no match of which goes on over a space between two characters that are not white space.
SPACED = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)

#: A pair that the merge table does not have.
NONE = (1 << 31) - 1

#: One row per word: its tokens, and the ranks that the merge table gives for each two neighbours. Each round contracts
#: every word's leftmost pair of least rank and looks up the two pairs that changed; a word without a pair ends.
SHORT_SQL = f"""
WITH RECURSIVE step(w, t, r) AS (
  SELECT w, t, r FROM tok
  UNION ALL
  SELECT w, list_concat(list_append(t[:p - 1], best), t[p + 2:]),
         list_concat(CASE WHEN p > 1 THEN list_append(r[:p - 2], coalesce(a.m, {NONE})) ELSE [] END,
                     CASE WHEN p < len(r) THEN list_prepend(coalesce(b.m, {NONE}), r[p + 2:]) ELSE [] END)
  FROM (SELECT *, list_position(r, best) AS p FROM (SELECT w, t, r, list_min(r) AS best FROM step) WHERE best < {NONE}) x
  LEFT JOIN merges a ON a.ab = ((t[p - 1]::BIGINT << 32) | best)
  LEFT JOIN merges b ON b.ab = ((best::BIGINT << 32) | t[p + 2])
)
SELECT w, t AS ids FROM step WHERE coalesce(list_min(r), {NONE}) = {NONE} ORDER BY w
"""

#: The same fixpoint for long words. Equal pairs of a word's least rank are contracted in
#: one round, leftmost first and without overlap; where a merged token could at once start
#: a pair of lower rank (``merges.alone``), only the leftmost is. A token that is gone has t = -1.
LONG_SQL = """
WITH RECURSIVE step(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM tok
  UNION
  SELECT w, p, CASE WHEN hit THEN best ELSE -1 END
  FROM (
    SELECT *, lag(hit) OVER (PARTITION BY w ORDER BY p) AS before
    FROM (
      SELECT *, coalesce(m = best AND CASE WHEN alone THEN p = first_p
                         ELSE (k - 1 - max(CASE WHEN m = best THEN 0 ELSE k END)
                               OVER (PARTITION BY w ORDER BY p)) % 2 = 0 END, false) AS hit
      FROM (
        SELECT *, min(CASE WHEN m = best THEN p END) OVER (PARTITION BY w) AS first_p
        FROM (
          SELECT x.*, m.m, m.alone, min(m.m) OVER (PARTITION BY w) AS best
          FROM (SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS u,
                       row_number() OVER (PARTITION BY w ORDER BY p) AS k
                FROM recurring.step WHERE t >= 0) x
          LEFT JOIN merges m ON m.ab = ((x.t::BIGINT << 32) | x.u)))
      WHERE best IS NOT NULL))
  WHERE hit OR before
)
SELECT w, list(t ORDER BY p) AS ids FROM step WHERE t >= 0 GROUP BY w ORDER BY w
"""

#: Tokens of a row to decode, so that fewer rows are ordered; what a text's last row lacks is a token without bytes.
ABREAST = 4
DECODE_SQL = f"""
SELECT d, unhex(array_to_string(list({" || ".join(f"v{k}.hex" for k in range(ABREAST))} ORDER BY p), '')) AS bytes
FROM toks {" ".join(f"JOIN vocabulary v{k} ON v{k}.id = toks.id{k}" for k in range(ABREAST))} GROUP BY d ORDER BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _connection():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '128MB'; SET preserve_insertion_order = false; SET allocator_flush_threshold = '4MB'")
    # a query that outgrows its memory spills where the task's other spills go, not to the current folder
    con.execute(f"SET temp_directory = '{tempfile.gettempdir()}/duckdb-{os.getpid()}'")
    return con


class Encoder:
    """Splits texts by a pattern and encodes the words; a bounded cache keeps known words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.at_spaces = ranks, regex.compile(pattern).findall, pattern in SPACED
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        if self.byte.min() < 0:
            raise ValueError("every single byte needs a rank")
        rows = [
            (a, b, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        ]
        a, b, m = np.array(rows or np.empty((0, 3)), dtype=np.int64).T
        early = {int(x) for x in np.concatenate([a[m < a], b[m < b]])}  # tokens in pairs of a rank below their own
        alone = np.array([int(x) in early for x in m], dtype=bool)
        self.con = _connection()
        self.con.register("given", pa.table({"ab": a << 32 | b, "m": m.astype(np.int32), "alone": alone}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.pair = np.full(1 << 16, NONE, dtype=np.int32)  # what the merge table gives for two bytes
        place = {int(x): i for i, x in enumerate(self.byte)}
        for x, y, rank in rows:
            if x in place and y in place:
                self.pair[place[x] << 8 | place[y]] = rank
        self.token: dict[int, bytes] | None = None  # made for the first long word
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _merge(self, words: list[bytes], query: str) -> list[bytes]:
        lengths = np.array([len(x) for x in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        t, ends = self.byte[flat], np.cumsum(lengths)
        if query is SHORT_SQL:
            r = np.delete(self.pair[flat.astype(np.int64) << 8 | np.append(flat[1:], 0)], ends - 1)
            starts, places = (np.concatenate([[0], x]).astype(np.int32) for x in (ends, ends - np.arange(1, len(words) + 1)))
            lists = {"t": pa.ListArray.from_arrays(starts, pa.array(t)), "r": pa.ListArray.from_arrays(places, pa.array(r))}
            self.con.register("tok", pa.table({"w": np.arange(len(words), dtype=np.int32)} | lists))
        else:
            w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
            p = np.arange(len(flat), dtype=np.int32) - np.repeat(ends - lengths, lengths).astype(np.int32)
            self.con.register("tok", pa.table({"w": w, "p": p, "t": t}))
        ids = self.con.sql(query).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("tok")
        values, offsets = np.asarray(ids.values).astype("<i4"), ids.offsets.to_pylist()
        return [values[i:j].tobytes() for i, j in zip(offsets, offsets[1:])]

    def _fresh(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words that the cache lacks."""
        fresh: dict[str, bytes] = {}
        short, long = [], []
        for word in words:
            if word not in self.words:
                raw = word.encode()
                if (known := self.ranks.get(raw)) is not None:
                    fresh[word] = known.to_bytes(4, "little")
                else:
                    (long if len(raw) > LONG_WORD else short).append((word, raw))
        fresh.update((word, self._in_pieces(raw)) for word, raw in long)
        fresh.update(zip((w for w, _ in short), self._merge_all([x for _, x in short])))
        return fresh

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; several queries, so that none makes too many rows."""
        out, part, rows = [None] * len(words), [], 0
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):
            if len(words[i]) > LONG_WORD:
                out[i] = self._merge([words[i]], LONG_SQL)[0]
                continue
            part.append(i)
            rows += len(words[i]) ** 2 // 2  # at most so many rows over all rounds
            if rows > QUERY_ROWS:
                for k, ids in zip(part, self._merge([words[k] for k in part], SHORT_SQL)):
                    out[k] = ids
                part, rows = [], 0
        for k, ids in zip(part, self._merge([words[k] for k in part], SHORT_SQL) if part else ()):
            out[k] = ids
        return out

    def _fit(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """The pairs of tokens that stay these two when their bytes are encoded as one word."""
        rows = list(pairs)
        made = self._merge_all([self.token[a] + self.token[b] for a, b in rows])
        return {p for p, ids in zip(rows, made) if np.frombuffer(ids, "<i4").tolist() == list(p)}

    def _in_pieces(self, raw: bytes) -> bytes:
        """The ids of a long word, by pieces.

        A sequence of tokens is what contracting leftmost pairs of least rank makes of a word if
        and only if this holds for every two neighbours of it and their bytes. For take the first
        contraction of the whole word that crosses a border of the sequence, between the tokens
        x and y. All contractions before it lay inside tokens, and those inside x and y come in the
        same order, with the same choices, when x and y are a word of their own; so there the crossing
        pair is contracted too, and the two do not stay. So pieces are encoded alone, and where the
        two tokens at a seam do not fit, what is around the seam is encoded as one, with twice as
        much around it in each further round. In the worst case that is the whole word.
        """
        if self.token is None:
            self.token = {i: x for x, i in self.ranks.items()}
        cut = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        made = dict(zip(distinct := list(dict.fromkeys(cut)), self._merge_all(distinct)))
        pieces_ = [np.frombuffer(made[x], "<i4").tolist() for x in cut]
        width, good = SEAM, set()
        while True:
            seams = [(a[-1], b[0]) for a, b in zip(pieces_, pieces_[1:])]
            good |= self._fit(set(seams) - good)
            if all(x in good for x in seams):
                return np.array(list(chain.from_iterable(pieces_)), dtype="<i4").tobytes()
            # parts of the word: a piece as it is, or bytes to encode anew
            parts: list = [pieces_[0]]
            i = 1
            while i < len(pieces_):
                if seams[i - 1] in good:
                    parts.append(pieces_[i])
                    i += 1
                    continue
                around, left = b"", width
                while parts and left > 0:
                    last = parts.pop()
                    rest, taken = ([], last) if isinstance(last, bytes) else self._taken(last, left, -1)
                    around, left = taken + around, left - len(taken)
                    if rest:
                        parts.append(rest)
                rest, left = [], width
                while i < len(pieces_) and left > 0:
                    rest, taken = self._taken(pieces_[i], left, 1)
                    around, left, i = around + taken, left - len(taken), i + 1
                parts += [x for x in (around, rest) if x]
            anew = [x for x in parts if isinstance(x, bytes)]
            made = dict(zip(distinct := list(dict.fromkeys(anew)), self._merge_all(distinct)))
            pieces_ = [np.frombuffer(made[x], "<i4").tolist() if isinstance(x, bytes) else x for x in parts]
            width *= 2

    def _taken(self, ids: list[int], width: int, side: int) -> tuple[list[int], bytes]:
        """What is left of a piece, and the bytes of its last (-1) or first (1) tokens, ``width`` bytes or more if it has them."""
        n = size = 0
        while n < len(ids) and size < width:
            size += len(self.token[ids[-1 - n] if side < 0 else ids[n]])
            n += 1
        if side < 0:
            return ids[: len(ids) - n], b"".join(self.token[i] for i in ids[len(ids) - n :])
        return ids[n:], b"".join(self.token[i] for i in ids[:n])

    def encode(self, docs: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        No match of a pattern of SPACED goes on over a space between two characters that are
        not white space, so text is looked up by what stands between spaces; other texts, and
        all by another pattern, are split whole.
        """
        if not self.at_spaces:
            split = [self.split(x) for x in docs]
            fresh = self._fresh(set(chain.from_iterable(split)))
            return [b"".join([self.words.get(w) or fresh[w] for w in row]) for row in split]
        rows = [x.split(" ") for x in docs]
        unsafe: set[str] = set()
        fresh_parts = []
        for x in set(chain.from_iterable(rows)):
            if x not in self.spaced:
                if not x or x[0].isspace() or x[-1].isspace():
                    unsafe.add(x)
                else:
                    fresh_parts.append(x)
        # one split for all: the words that begin with a space begin a part
        words = self.split(" " + " ".join(fresh_parts)) if fresh_parts else []
        ends = [i for i, word in enumerate(words) if word[0] == " "] + [len(words)]
        whole, heads = {}, {}
        for i, row in enumerate(rows):
            if len(row) == 1 or not row[0] or row[0][-1].isspace() or (unsafe and not unsafe.isdisjoint(row)):
                whole[i] = self.split(docs[i])
            else:
                heads[i] = self.split(row[0])
        fresh = self._fresh(set(chain(words, *whole.values(), *heads.values())))

        def ids(found: list[str]) -> bytes:
            return b"".join([self.words.get(w) or fresh[w] for w in found])

        spaced = {x: ids(words[i:j]) for x, i, j in zip(fresh_parts, ends, ends[1:])}
        out = []
        for i, row in enumerate(rows):
            if i in whole:
                out.append(ids(whole[i]))
                continue
            got = list(map(self.spaced.get, row))
            got[0] = ids(heads[i])
            if None in got:
                got = [spaced[x] if y is None else y for x, y in zip(row, got)]
            out.append(b"".join(got))
        self.spaced.update(islice(spaced.items(), max(0, CACHE_PARTS - len(self.spaced))))
        self.words.update(islice(fresh.items(), max(0, CACHE_WORDS - len(self.words))))
        return out


class Decoder:
    """Turns ids back into bytes by an ordered aggregation."""

    def __init__(self, ranks: dict[bytes, int], con=None):
        self.con = con or _connection()
        self.size = max(ranks.values(), default=-1) + 1
        self.known = np.zeros(self.size, dtype=bool)
        self.known[list(ranks.values())] = True
        self.con.register("given", pa.table({"id": pa.array([*ranks.values(), self.size], pa.int32()), "hex": [*(x.hex() for x in ranks), ""]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")

    def _part(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(lengths)
        rows = -(-lengths // ABREAST)
        dealt = np.full(int(rows.sum()) * ABREAST, self.size, dtype=np.int32)
        before = (np.cumsum(rows) - rows) * ABREAST - (np.cumsum(lengths) - lengths)
        dealt[np.arange(len(ids)) + np.repeat(before, lengths)] = ids
        toks = {"d": np.repeat(np.arange(len(lengths), dtype=np.int32), rows), "p": np.arange(len(dealt) // ABREAST, dtype=np.int32)}
        self.con.register("toks", pa.table(toks | {f"id{k}": np.ascontiguousarray(dealt[k::ABREAST]) for k in range(ABREAST)}))
        for row, value in self.con.execute(DECODE_SQL).fetchall():
            out[row] = value
        self.con.unregister("toks")
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of rows of so many ids each, DECODE_TOKENS at a time or one longer row."""
        ends, start, out = np.cumsum(lengths), 0, []
        while start < len(lengths):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + DECODE_TOKENS, side="right")))
            out += self._part(ids[base : ends[stop - 1]], lengths[start:stop])
            start = stop
        return out


class Codec:
    """An encoder, and a decoder in the same database."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.encoder = Encoder(ranks, pattern)
        self.decoder = Decoder(ranks, self.encoder.con)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False
) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of each row, as the rank file gives them.

    Each match of ``pattern`` is encoded separately, without special tokens. A null or empty
    text has no ids. With ``decoded``, a column of this name holds the bytes that the ids decode
    to, as ``decode`` gives them. Columns of ``keep`` that are called ``ids`` or ``decoded`` are
    refused. The rank file must lie at ``ranks_path`` on every machine. A Python worker keeps
    its encoder, with at most CACHE_WORDS words, from task to task.
    """
    made = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded": T.BinaryType()} if decoded else {})
    refuse(keep, "ids", "decoded")
    kept = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and its passes over the many small lists cost a tenth
        try:
            for i, batch in enumerate(pieces(batches, "__text", TEXT_BYTES)):
                if i % 16 == 0:
                    give_back()
                codec = kept_by_worker(("bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))
                rows = codec.encoder.encode(texts(batch.column("__text")))
                lengths = np.array([len(x) // 4 for x in rows], dtype=np.int64)
                values = np.frombuffer(b"".join(rows), dtype="<i4")
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                columns = [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(values))]
                if decoded:
                    columns.append(pa.array(codec.decoder.decode(values, lengths), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *made])
        finally:
            if collecting:
                gc.enable()

    return kept.mapInArrow(work, extended(kept.drop("__text"), **made))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded``, and ``decoded`` (binary): the bytes of the ids.

    Null or empty ids give no bytes; an id outside the vocabulary fails. A column that is
    called ``decoded`` already is replaced.
    """
    names = [c for c in encoded.columns if c != "decoded"]
    kept = encoded.select(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoder = kept_by_worker(("bpe ids", ranks_path), lambda: Decoder(read_ranks(ranks_path)))
            lengths = np.asarray(pc.list_value_length(batch.column(ids)).fill_null(0)).astype(np.int64)
            flat = np.asarray(batch.column(ids).flatten()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoder.decode(flat, lengths), pa.binary())], [*names, "decoded"])

    return kept.mapInArrow(work, extended(kept, decoded=T.BinaryType()))
