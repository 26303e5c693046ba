import hashlib
import tracemalloc

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fairground.llm import bpe
from fairground.llm.queries import PATTERN, RANKS

ranks = bpe.read_ranks(RANKS)
codec = bpe.BpeCodec(ranks, PATTERN)
reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@given(st.text(alphabet="abthe .'\né", max_size=300))
@settings(max_examples=200, deadline=None)
def test_repetitive_text(text):
    assert codec.encode(text) == reference.encode_ordinary(text)


def test_steps_back_from_longest_matches():
    # Ranks where the longest match is not what the merges give.
    small = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"cd": 259}
    own = bpe.BpeCodec(small, r"\S+")
    tik = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=small, special_tokens={})
    for word in ("abcd", "ab", "abcab", "aabbccdd", "bcd", "abcdabcd", "abab"):
        assert own.encode(word) == tik.encode_ordinary(word)


def test_long_piece_in_linear_time():
    text = "ab" * 50_000
    assert codec.encode(text) == reference.encode_ordinary(text)


def test_long_piece_in_bounded_memory():
    own = bpe.BpeCodec(ranks, PATTERN)
    for text in ("=" * 200_000, "ab" * 50_000 + "\u00e9" * 200_000):
        tracemalloc.start()
        n, _, decoded = own.digest(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 1 and decoded == hashlib.sha256(text.encode()).hexdigest()
        assert peak < 60 * len(text.encode()), peak / len(text.encode())
    assert not any(len(p) > bpe.SHORT for p in own.pieces.new)


def test_step_back_in_long_pieces():
    text = "=" * 40_001 + "ab" * 3_000 + "a" * 3_001
    assert codec.encode(text) == reference.encode_ordinary(text)
    data = text[:40_001].encode()
    longest = [0] * len(data)
    for end, size in codec.automaton.iter(data.decode("latin-1")):
        longest[end + 1 - size] = end + 1
    assert list(codec.stepped_back(data, longest)) == list(codec.encode_piece(data))


def test_memory_is_bounded():
    m = bpe.Memory(3)
    for i in range(20):
        m.put(i, i)
        assert len(m.new) <= 3 and len(m.old) <= 3
    assert m.get(19) == 19 and m.get(0) is None


def test_round_trip_query(spark):
    rows = [(1, "Hello wörld", "x"), (2, None, None), (3, "", ""), (4, "a" * 100_000, ""), (4, "a" * 100_000, ""), (None, "日本 <|endoftext|>", "")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), RANKS, PATTERN).collect()
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0


def test_id_columns(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_ids(docs, RANKS, PATTERN), RANKS, PATTERN).orderBy("doc_id").collect()
    assert bytes(back[0].decoded) == b"one two" and bytes(back[1].decoded) == b""


def test_missing_bytes_are_told():
    with pytest.raises(ValueError):
        bpe.BpeCodec({b"a": 0}, r"\S+").encode("ab")
