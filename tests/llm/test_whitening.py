import numpy as np
import pytest

from fairground.llm import whitening
from fairground.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "own", None) for i, v in rows], SCHEMA)


def plain(vectors, k=4, scale=256):
    """Eigenvectors of the plain covariance of distinct fixed-point vectors, and exact deviations."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * scale).astype(np.int64)
    u = np.unique(x, axis=0)
    n, sums = len(u), [int(s) for s in u.sum(axis=0)]
    centred = u - u.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    values, across = values[order], vectors[:, order].T
    dev = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return n, dev, (x - u.mean(axis=0)) @ across.T / np.sqrt(values), values / np.trace(cov)


def check(rows, ids, vectors, k=4):
    n, dev, white, explained = plain(vectors, k)
    found = {}
    for r in rows:
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == len(ids) * k
    for i, d, w in zip(ids, dev, white):
        for c in range(1, k + 1):
            r = found[i, c].pop()
            assert (r.n, int(r.deviation)) == (n, d)
            sign = np.sign(w[c - 1]) * np.sign(r.whitened)
            assert abs(r.whitened - sign * w[c - 1]) < 1e-7 and abs(r.explained - explained[c - 1]) < 1e-9 and r.identity_error < 1e-9


def test_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 12)) * np.arange(1, 13) * 0.2).astype(np.float32).round(4)
    v[10], v[200] = v[11], v[11]  # repeated vectors count once in the fit
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    bad = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] + [1.0] * 11), (904, [float("inf")] * 12), (905, [1.0, 2.0])]
    out = whitening.report(frame(spark, rows + bad).repartition(3)).collect()
    check(out, range(300), v)


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(50, 3)).astype(np.float32)
    out = whitening.report(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), k=3).collect()
    white = plain(v, 3)[2]
    for c in (1, 2, 3):
        ours = np.array([r.whitened for r in sorted(out, key=lambda r: r.vec_id) if r.component == c])
        assert np.allclose(ours, white[:, c - 1], atol=1e-8) or np.allclose(ours, -white[:, c - 1], atol=1e-8)


def test_fewer_dimensions_than_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [0.0, 9.0]), (3, [0.0, 9.0]), (None, [5.0, 1.0])]
    out = whitening.report(frame(spark, rows)).collect()
    assert len(out) == 5 * 2 and {r.n for r in out} == {4} and {r.component for r in out} == {1, 2}


def test_flat_vectors_have_fewer_components(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0, -float(i)]) for i in range(20)]
    out = whitening.report(frame(spark, rows)).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.report(frame(spark, rows)).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(1, [3e13, 1.0]), (2, [-3e13, 2.0]), (3, [1e13, 4.0])]
    exact = {r.vec_id: int(r.deviation) for r in whitening.report(frame(spark, rows)).collect()}
    x = np.array([np.floor(256 * np.float32(a).astype(float)) for _, v in rows for a in v]).reshape(3, 2)
    sums = [int(x[:, j].sum()) for j in range(2)]
    assert exact == {i + 1: sum((3 * int(x[i, j]) - sums[j]) ** 2 for j in range(2)) for i in range(3)}


def test_negative_numbers_are_floored(spark):
    df = frame(spark, [(1, [-0.001, 0.0, -0.0, 0.999])])
    assert df.select(whitening.fixed_point(whitening.F.col("embedding"), 256).alias("x")).first().x == [-1, 0, 0, 255]


def test_other_columns_pass(spark):
    rows = frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.5])])
    model = whitening.fit(whitening.fit_list(rows), 1)
    assert whitening.whiten(rows, model).select("row.*").columns == rows.columns


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(op12_whitening(spark, d).collect(), [r.vec_id for r in table], [r.embedding for r in table])
