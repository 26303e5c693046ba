import numpy as np

from fairground.llm import media as M

rng = np.random.default_rng(4)
PHOTOS = [M.texture(rng.normal(size=64)) for _ in range(12)]


def edits(x):
    blotted = x.copy()
    blotted[20:32, 20:32] = 255
    return {
        "crop": x[8:, 5:],
        "brighter": np.clip(x * 0.8 + 20, 0, 255),
        "noise": np.clip(x + rng.normal(0, 3, x.shape), 0, 255),
        "blot": blotted,
        "turned": np.rot90(x),
    }


def run(spark, rows, **s):
    df = spark.createDataFrame([(i, None if x is None else bytearray(x), 1) for i, x in rows], "vec_id long, image binary, c int")
    return {r.vec_id: r for r in M.find_copies(df, "vec_id", df.image, M.Settings(**s)).collect()}


def test_edits_are_found_and_others_left_alone(spark):
    rows, source = [], {}
    for n, x in enumerate(PHOTOS):
        variants = [x, x] + (list(edits(x).values()) if n < 6 else [])
        for v in variants:
            source[len(rows)] = n
            rows.append((len(rows), M.pgm(np.asarray(v))))
    for block in (512, 4):
        got = run(spark, rows, block=block)
        first = {n: min(i for i in source if source[i] == n) for n in source.values()}
        assert all(got[i].class_id == first[source[i]] for i in source)
        assert all(got[i].n_links >= 1 for i in source) and all(got[i].n_links == 1 for i in source if source[i] >= 6)
        assert all(got[i].copy_id == first[source[i]] for i in source if i - first[source[i]] < 2)


def test_odd_images(spark):
    flat = M.pgm(np.full((64, 64), 7))
    got = run(spark, [(1, None), (2, b""), (3, b"not an image"), (4, flat), (5, flat), (6, M.pgm(np.zeros((3, 3)))), (7, b"P5\n9 9\n255\nxx")])
    assert [got[i].class_id for i in range(1, 8)] == [1, 2, 3, 4, 4, 6, 7]
    assert all(got[i].n_corners == 0 for i in got) and got[4].n_links == got[5].n_links == 1
    assert run(spark, []) == {}


def test_textures_of_odd_vectors():
    assert M.texture(None) is None and M.texture([]).shape == M.texture([1.0, None, float("nan")]).shape == (80, 80)
    assert (M.texture([1.0]) != M.texture([1.5])).any() and (M.texture([1.0]) == M.texture([1.0])).all()


def test_large_images_and_repeated_rows(spark):
    big = np.random.default_rng(8).integers(0, 256, (150, 150)).repeat(8, 0).repeat(8, 1)
    images = [(1, M.pgm(big)), (1, M.pgm(big)), (2, M.pgm(big[:-80, :-64])), (3, M.pgm(PHOTOS[0]))]
    df = spark.createDataFrame([(i, bytearray(x), 5, 6) for i, x in images], "vec_id long, image binary, class_id int, n_links int")
    got = M.find_copies(df, "vec_id", df.image).collect()
    assert sorted((r.vec_id, r.class_id, r.n_links) for r in got) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]


def test_query_finds_the_edits_it_makes(spark, tmp_path):
    from fairground.llm.queries import op7_media

    own = np.random.default_rng(6)
    rows = [(i, own.normal(size=8).astype(float).tolist(), 0) for i in range(400)] + [(400, None, 0), (None, [1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op7_media(spark, str(tmp_path)).collect()
    made = [r for r in got if r.edit]
    assert len(got) - len(made) == len(rows) and {r.edit for r in made} == set(M.EDITS)
    assert sum(r.class_id == r.vec_id and r.n_links == 1 for r in made) >= 0.9 * len(made)
    assert all(r.class_id == r.vec_id for r in got) and sum(r.n_links for r in got) == sum(r.n_links for r in made) * 2


def test_pairs_are_counted_for_themselves(spark):
    # Each part that 10 and 11 share is held by another image with a smaller number, too.
    rows = [(p, no) for p in range(6) for no in (p, 10, 11)] + [(p, 12) for p in range(5)]
    parts = spark.createDataFrame(rows, "part long, no long")
    for block in (512, 1):
        assert sorted(map(tuple, M.sharing_pairs(parts, 6, block).collect())) == [(10, 11)]
        assert sorted(map(tuple, M.sharing_pairs(parts, 5, block).collect())) == [(10, 11), (10, 12), (11, 12)]


def test_strong_edits_are_found_as_by_all_pairs(spark):
    s, own = M.Settings(), np.random.default_rng(5)
    images = [y for x in PHOTOS for y in (x, np.clip(x + own.normal(0, 15, x.shape), 0, 255), np.clip(x * 0.5 + own.normal(0, 6, x.shape), 0, 255), M.edited(x, "crop"))]
    images = [np.asarray(x).astype(np.uint8) for x in images]
    seen = [M.describe(x, s) for x in images]
    n_links = [sum(i != j and M.agreeing(*seen[min(i, j)], *seen[max(i, j)], s) >= s.agreeing for j in range(len(seen))) for i in range(len(seen))]
    got = run(spark, [(i, M.pgm(x)) for i, x in enumerate(images)])
    assert min(n_links) >= 1 and [got[i].n_links for i in range(len(images))] == n_links
