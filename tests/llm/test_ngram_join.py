import random
import re
from collections import Counter

import numpy as np

from fairground.llm import ngram_join as N


def grams(t, n=5):
    w = re.findall(r"\w+", (t or "").lower())
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [(i, grams(t)) for i, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-12:
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = top(k)
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    return sorted(((i, least[top(k)], links[k]) for k, (i, _) in enumerate(sets)), key=str)


def texts(seed=1, groups=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.choice((3, 7, 30, 200, 400)))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w) if r.random() < 0.7 else ", ".join(w).upper()))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "?! ..."), (n + 3, "one"), (n + 4, "One."), (n + 5, "x y " * 60_000), (n + 5, "x y " * 60_000)]


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, class_id int, sig string")
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in N.groups(df, settings=N.Settings(**k)).collect()), key=str)


def test_links_and_groups(spark):
    rows = texts()
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_large_group(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(150)] = f"v{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, block=6) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert run(spark, []) == []
    got = run(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r")])
    assert got == sorted([(None, 3, 1), (3, 3, 1), (None, None, 0)], key=str)


def test_keep_one_of_each_group(spark):
    rows = texts(7)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, root int")
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    wanted = {c for i, c, _ in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_keep_one_tells_words_as_the_shingles_do(spark):
    rows = [(1, "\u200d"), (2, "\u200d"), (3, "\u0301!"), (4, "\u00b2"), (5, "\u00b2"), (6, "\u5b57"), (7, ""), (8, None), (9, "_"), (10, "_")]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_bayesian_bounds():
    s = N.Settings()
    bounds = N.fewest_matches(s)
    assert [n for n, _ in bounds] == [40, 80, 120, 160]
    assert all(0 < k < 0.8 * n for n, k in bounds)
    rng = np.random.default_rng(0)
    agree = (rng.random((20_000, 160)) < 0.8).cumsum(1)
    assert all((agree[:, n - 1] >= k).mean() > 0.9999 for n, k in bounds)


def test_overlaps_agree_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    i, j = np.tile(i, 2), np.tile(j, 2)
    assert len(i) >= 2_000
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert N.overlaps(sets, sets, i, j).tolist() == want
    assert N.overlaps(sets, sets, i[:50], j[:50]).tolist() == want[:50]
