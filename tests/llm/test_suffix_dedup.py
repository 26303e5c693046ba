import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fairground.llm import suffix_dedup as S

SMALL = dict(length=40, seed=16, shallow=8)


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone, last = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                for k in range(max(last, p), p + length):
                    gone[k] = 1
                last = p + length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=40, letters="abcdef é"):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    shared = [word(r.choice((39, 40, 41, 60, 150))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            x = r.choice(shared) if r.random() < 0.5 else word(r.randint(0, 90))
            if r.random() < 0.3 and len(x) > 3:
                k = r.randrange(len(x))
                x = x[:k] + "#" + x[k + 1 :]
            parts.append(x)
        rows.append((i, "".join(parts)))
    return rows


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, spans string, kept int")
    got = S.span_report(df, settings=S.Settings(**(SMALL | k))).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)


def test_random_texts(spark):
    for seed in (1, 2):
        rows = texts(seed)
        assert run(spark, rows) == brute(rows, 40)


def test_periodic_and_odd_texts(spark):
    rows = [(1, "ab" * 60), (2, "a" * 500), (3, None), (4, ""), (5, "é" * 100), (6, "short"), (7, "abc" * 40 + "x"), (8, "same text, long enough to count as a repeat of itself"), (8, "same text, long enough to count as a repeat of itself"), (None, "null id " * 3 + "q" * 20 + "z" * 10), (None, "other null " + "q" * 20 + "z" * 10 + "1234567890")]
    assert run(spark, rows) == brute(rows, 40)


def test_hot_owner_in_blocks(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghij ") for _ in range(120))
    rows = [(i, "".join(r.choice("klmno") for _ in range(r.randint(0, 30))) + r.choice("xy") + passage + r.choice("xyz") + str(i)) for i in range(60)]
    want = brute(rows, 40)
    assert run(spark, rows, block=4, chunk=10) == want
    assert run(spark, rows) == want


def test_very_long_text(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(700_000))
    rows = [(1, long), (2, "start " + long[650_000:650_100] + " end")]
    assert run(spark, rows) == brute(rows, 40)


def test_windows_that_no_run_owns():
    import pandas as pd

    s = S.Settings(length=8, seed=3, shallow=8)
    frame = pd.DataFrame({"group": ["a", "b"], "own": [1, 5], "bytes": [b"abcdefgh", b"12345678"]})
    assert [h.tolist() for h in S.repeated_windows(frame, s)] == [[False], [False]]
    assert S.repeated_windows(frame[:0], s) == []


def test_empty_table(spark):
    assert run(spark, []) == []


def test_cut_texts_keep_columns(spark):
    rows = [(1, "x" + "é" * 30 + "first"), (2, "yé" + "é" * 30 + "second"), (3, None)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, rest string")
    got = {r.doc_id: r for r in S.dedup_spans(df, settings=S.Settings(**SMALL)).collect()}
    assert got[1].text == "xfirst" and got[2].text.startswith("y") and got[2].text.endswith("second") and got[3].text == ""
    assert got[1].rest == "c" and got[1].n_removed == 60 and bytes(got[1].kept) == b"xfirst"


@given(st.lists(st.tuples(st.integers(0, 3), st.text(alphabet="ab", max_size=60)), max_size=40), st.sampled_from([0, 8, 16]))
@settings(max_examples=150, deadline=None)
def test_deep_shallow_order(items, shallow):
    strings, group = [t.encode() for _, t in items], np.array([g for g, _ in items], np.int64)
    order, lcp = S.deep_shallow_sort(strings, group, 0, shallow)
    assert sorted(order.tolist()) == list(range(len(items)))
    ordered = [(group[i], strings[i]) for i in order]
    assert ordered == sorted(ordered)
    for k in range(1, len(ordered)):
        if ordered[k][0] == ordered[k - 1][0]:
            assert lcp[k] == S.common_prefix(ordered[k][1], ordered[k - 1][1])
        else:
            assert lcp[k] == -1


@given(st.lists(st.binary(max_size=12), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_blind_trie_sorts(strings):
    order = S.trie_order(strings, list(range(len(strings))))
    assert [strings[i] for i in order] == sorted(strings)


def test_thue_morse_texts(spark):
    """Strings on which polynomial hashes modulo a power of two collide, whatever their base."""
    t = "a"
    while len(t) < 1024:
        t += t.translate(str.maketrans("ab", "ba"))
    one, two = t[:512], t[512:1024]
    rows = [(1, "x" + one + "y"), (2, "z" + two + "w"), (3, "q" + one), (4, "r" + two + two)]
    for length in (500, 512, 600):
        assert run(spark, rows, length=length, seed=200) == brute(rows, length)


def test_the_pipelines_length(spark):
    """Passages of over 50 words go at the pipeline's length, those of some words stay."""
    from corpus_pipeline import REPEATS

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (51, 55, 60, 80)] + [prose(12)]
    rows = [(i, " ".join([prose(30), p, prose(r.randint(0, 40))])) for i, p in enumerate(passages * 3)] + [(99, prose(300))]
    got = run(spark, rows, length=REPEATS.length, seed=REPEATS.seed, shallow=REPEATS.shallow)
    assert got == brute(rows, REPEATS.length)
    removed = {i: n for i, _, n, _, _ in got}
    assert all(removed[i] >= len(passages[i % 5]) for i in range(15) if i % 5 < 4)
    assert all(removed[i] == 0 for i in range(15) if i % 5 == 4) and removed[99] == 0
