from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairground.llm import phrases
from fairground.llm.queries import ORACLE_SQL, op11_phrases

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, words string"
SMALL = phrases.Settings(min_count=2, top=50, block_bytes=200)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 7, "x", None) for i, (t, g) in enumerate(rows)], SCHEMA)


def plain(rows, s):
    """All phrases counted one by one."""
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, (text or "").translate(lower)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, s.most_words + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= s.min_count}
    within = Counter()
    for (lang, w), a in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                within[lang, w[i : i + m]] = max(within[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * within[lang, w] < s.covered * a:
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[: s.top], 1)}


def got(docs, s=SMALL):
    return {tuple(r) for r in phrases.collocations(docs, settings=s).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


ROWS = [
    ("New York is big. New York is old! new york IS big", "en"),
    ("a a a a a a b a a b", "en"),
    ("a\tb  c,a b c\x0ba b\x0cc a;b:c", "en"),
    (None, "en"),
    ("", None),
    ("no language here; no language here; No language", None),
    ("no language", "und"),
    ("Ä Ö Ä Ö ÄÖ ä ö\nÄ Ö\r\nÄ Ö", "de"),
    ("same text twice over", "fr"),
    ("same text twice over", "fr"),
    ("... ,,, \n\n", "es"),
    ("nul \x00 nul \x00     x x x x", "zz"),
]


@pytest.mark.parametrize("words", [2, 3, 4])
def test_small_texts_equal_plain_counts(spark, words):
    s = phrases.Settings(most_words=words, min_count=2, top=50, block_bytes=200)
    expected = plain(ROWS, s)
    assert len(expected) > 8
    assert got(frame(spark, ROWS).repartition(3), s) == expected


def test_ties_are_cut_at_top(spark):
    rows = [("b c. a b. c a. x y. " * 2, "en")]
    s = phrases.Settings(min_count=2, top=3)
    assert got(frame(spark, rows), s) == plain(rows, s) and len(plain(rows, s)) == 3


def test_very_long_text_is_cut_between_words(spark, monkeypatch):
    rows = [("lorem ipsum dolor, sit amet " * 3000 + "y" * 50_000, "la"), ("z" * 100_000, "la")]
    monkeypatch.setattr(phrases, "SLICE", 1000)
    assert [w for part in phrases.words_of(rows[0][0]) for w in part] == (b"lorem ipsum dolor . sit amet " * 3000 + b"y" * 50_000).split()
    assert got(frame(spark, rows)) == plain(rows, SMALL)


def test_a_phrase_in_every_block_is_one_entry_a_block(spark):
    rows = [(f"in every text w{i}", "en") for i in range(300)]
    s = phrases.Settings(min_count=10, block_bytes=100)
    blocks = phrases.inverted_blocks(frame(spark, rows).repartition(2), *map(phrases.F.col, ("text", "lang")), s)
    assert blocks.count() > 20
    assert got(frame(spark, rows), s) == plain(rows, s)


def test_empty_table(spark):
    assert got(frame(spark, [])) == set()


def test_products_pass_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 2, 3_000_000_000_000, 5_000_000_000_000)], "lang string, phrase string, words int, f long, n long")
    ones = spark.createDataFrame([("en", "a", 1, 4_000_000_000_000, 5_000_000_000_000), ("en", "b", 1, 3_000_000_000_001, 5_000_000_000_000)], found.schema)
    original = phrases.frequent_phrases
    phrases.frequent_phrases = lambda *_: found.union(ones)
    try:
        assert got(found) == {("en", 1, "a b", 3 * 10**12, 4 * 10**12, 3 * 10**12 + 1, 5 * 10**12, 10**6 * 9 * 10**24 // (4 * 10**12 * (3 * 10**12 + 1)))}
    finally:
        phrases.frequent_phrases = original


@given(st.lists(st.integers(0, 1 << 31), max_size=50))
@settings(max_examples=30, deadline=None)
def test_arrays_come_back(values):
    for kind in ("i4", "u4", "u8"):
        a = np.array(values, np.uint64).astype(kind)
        assert (phrases.unpacked_array(phrases.packed_array(a), kind) == a).all()


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet')")
    cursor = con.execute(ORACLE_SQL["op11_phrases"])
    names = [c[0] for c in cursor.description]
    assert {tuple(r) for r in op11_phrases(spark, d).select(names).collect()} == set(cursor.fetchall())
