"""Words of many bytes without a split: pieces and seams against the public library."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidelog.llm import bpe


def test_long_words_equal_the_library():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=n)) for n in (513, 2000, 100_000)]
    words += ["".join(rng.choices("ACGT", k=5000)), "".join(rng.choices("aab", k=9000)), "".join(chr(rng.randint(0x4E00, 0x5000)) for _ in range(3000))]
    words += ["a" * 1_000_000, "x" + "ab" * 3000, "abc" * 2001, "xxy" + "a" * 5001 + "b", "the" * 2000, "=-" * 4999, " " * 5000 + "x"]
    for word in words:
        got = np.frombuffer(encoder.encode([word])[0], "<i4").tolist()
        assert got == own.encode_ordinary(word)
    # short words in pieces give the same as whole
    short = ["".join(rng.choices(letters, k=rng.randint(20, 400))) for _ in range(30)]
    whole = encoder._merge([x.encode() for x in short], bpe.SHORT_SQL)
    assert [encoder._in_pieces(x.encode()) for x in short] == whole


def test_decoding_rows_of_any_length_and_gaps_in_the_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, "é".encode(): 301}
    decoder = bpe.Decoder(ranks)
    rows = [[], [97], [300, 301], [300] * 3, [98] * 4, [301, 97, 300, 0, 255], [], list(range(256))]
    token = {i: x for x, i in ranks.items()}
    flat = np.array([i for r in rows for i in r], dtype=np.int32)
    assert decoder.decode(flat, np.array([len(r) for r in rows])) == [b"".join(token[i] for i in r) for r in rows]
    with pytest.raises(ValueError):  # within the range of the ranks, but none of them
        decoder.decode(np.array([97, 280], dtype=np.int32), np.array([2]))


def test_one_query_holds_the_words_of_a_piece_of_text(monkeypatch):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    words = sorted({f"{a}{b}{c}ßq{k}"[: 3 + k % 9].encode() for k, (a, b, c) in enumerate(itertools.product("thexzäö", repeat=3))})
    calls, merge = [], encoder._merge
    monkeypatch.setattr(encoder, "_merge", lambda part, query: calls.append(query) or merge(part, query))
    made = encoder._merge_all(words * 40)
    assert calls == [bpe.SHORT_SQL]
    assert made == merge(words, bpe.LONG_SQL) * 40
