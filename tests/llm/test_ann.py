import numpy as np

from fairground.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def run(spark, rows, every=10, k=10, **s):
    df = frame(spark, rows)
    got = ann.search(df, df.vec_id % every == 0, k, settings=ann.Settings(**s)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def brute(rows, every=10, k=10):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        best = [p for p in np.lexsort((ids, d)) if np.isfinite(d[p])][:k]
        out[ids[q]] = [(n + 1, ids[p], d[p]) for n, p in enumerate(best)]
    return out


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[rng.integers(12)] + rng.normal(0, 0.4, dims)).astype(np.float32).tolist()) for i in range(n)]


def same(a, b):
    return a.keys() == b.keys() and all([(x[0], x[1]) for x in a[q]] == [(x[0], x[1]) for x in b[q]] and np.allclose([x[2] for x in a[q]], [x[2] for x in b[q]], rtol=0, atol=1e-12) for q in a)


def test_recall_and_exact_scores(spark):
    rows = vectors(3000)
    got, want = run(spark, rows, 50), brute(rows, 50)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(np.sqrt(((x[q] - x[v]) ** 2).sum()) - d) < 1e-12 for q in got for _, v, d in got[q])


def test_lists_follow_the_table(spark):
    """More vectors have more lists, fitted in two levels, and recall stays."""
    rows = vectors(12_000, dims=8, seed=3)
    got, want = run(spark, rows, 400), brute(rows, 400)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = np.array([v for _, v in rows])
    c = ann.centroids_of(x, 110, 7)
    assert 100 <= len(c) <= 120
    sizes = np.bincount(ann.squared(x, c).argmin(1), minlength=len(c))
    assert sizes.max() < 6 * len(x) / len(c)


def test_few_vectors_are_searched_exactly(spark):
    for n in (1, 2, 9, 40):
        rows = vectors(n, seed=n)
        got, want = run(spark, rows, 3), {q: v for q, v in brute(rows, 3).items() if v}
        assert same(got, want)


def test_hot_vector_in_blocks_and_ties(spark):
    rows = vectors(600) + [(i, [1.0] * 16) for i in range(600, 900)]
    got = run(spark, rows, 100, block_rows=64)
    assert [v for _, v, _ in got[600]] == list(range(601, 611)) and all(d == 0 for *_, d in got[600])


def test_unusable_vectors_take_no_part(spark):
    good = vectors(30)
    bad = [(100, None), (110, []), (120, [0.0] * 16), (130, [float("nan")] + [1.0] * 15), (140, [None] + [1.0] * 15), (150, [float("inf")] + [1.0] * 15), (160, [1.0] * 15), (None, [1.0] * 16)]
    assert same(run(spark, good + bad), brute(good))


def test_repeated_ids_are_one_candidate(spark):
    rows = vectors(40)
    got = run(spark, rows + rows[:20])
    assert same(got, brute(rows))


def test_empty_table(spark):
    assert run(spark, []) == {} and run(spark, [(0, None)]) == {}


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(200, 8))
    g = ann.CentroidGraph(c, 16)
    x = rng.normal(size=(50, 8))
    ids, d = g.search(x, 10)
    want = np.argsort(((x[:, None] - c) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, want)]) > 9.3
    assert (np.diff(d, axis=1) >= 0).all()
