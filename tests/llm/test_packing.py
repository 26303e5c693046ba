import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fairground.llm import packing
from fairground.llm.queries import PATTERN, RANKS, TOKENIZER

SCHEMA = "doc_id long, text string, start string, `offset` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)


def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@given(st.lists(st.integers(1, 400), max_size=40), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_partition_is_whole_and_even(sizes, k):
    found = packing.partition(sizes, k)
    assert len(found) == k and sorted(i for w in found for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) <= max(sizes, default=0)


def test_differencing_beats_naive_split():
    # The textbook case: largest differencing gives 16 and 14.
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.partition([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_windows_rise_when_capacity_is_exceeded():
    found = packing.windows_of([6, 6, 6], 9)
    assert len(found) == 3 and all(sum([6, 6, 6][i] for i in w) <= 9 for w in found)


def check(spark, rows, capacity=64):
    out = packing.pack(frame(spark, rows).repartition(2), RANKS, PATTERN, capacity=capacity, end_id=0, tokenizer_path=TOKENIZER).collect()
    t = tokenizer()
    texts = defaultdict(list)
    for i, x in rows:
        texts[i].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4"))
    by_sequence, covered = defaultdict(list), defaultdict(int)
    for r in out:
        assert r.length > 0 and r.doc_tokens in {len(x) for x in texts[r.doc_id]}
        part = np.array(r.ids, "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
        assert any((x[r.start : r.start + r.length] == part).all() for x in texts[r.doc_id] if len(x) >= r.start + r.length)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
    assert covered == {i: sum(map(len, x)) for i, x in texts.items()}
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(covered.values())


def test_pack_matches_the_tokenizer(spark):
    rows = [(i, "The quick brown fox, no. %d!\n\n" % i * (i % 37)) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "é" * 5000), (503, "same"), (503, "same"), (None, "no id <|endoftext|> 日本語"), (505, "x <|endoftext|> y"), (504, "a" * 30000)]
    padding, total = check(spark, rows)
    assert padding <= 0.1 * total


@pytest.mark.parametrize("blanks", [" ", "\n", " \n\t", "\u00a0"])
def test_very_long_white_space(spark, blanks):
    text = "a" + blanks * (2_000_000 // len(blanks)) + "x"
    with_file, own = packing.ids_of(text, RANKS, PATTERN, TOKENIZER), packing.ids_of(text, RANKS, PATTERN)
    assert with_file.tolist() == own.tolist() == tokenizer().encode(text, add_special_tokens=False).ids
    got = packing.pack(frame(spark, [(1, text)]), RANKS, PATTERN, with_ids=False, tokenizer_path=TOKENIZER)
    assert sum(r.length for r in got.select("length").collect()) == len(own) + 1


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), RANKS, PATTERN).count() == 0


def test_little_padding(spark):
    rows = [(i, "word " * (13 * i % 700)) for i in range(600)]
    padding, total = check(spark, rows, 1024)
    assert padding < 0.03 * total


def test_special_tokens_have_their_ids():
    assert packing.ids_of("x <|endoftext|> y", RANKS, PATTERN, TOKENIZER).tolist() == [87, 220, 50256, 331]
    assert len(packing.ids_of("x <|endoftext|> y", RANKS, PATTERN)) == 9
