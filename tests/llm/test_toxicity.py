import random

import numpy as np

from fairground.llm import toxicity as T

BAD = ("grobvile", "nastix", "meanort")


def corpus(n, seed):
    r = random.Random(seed)
    words = {"en": "the of and to in is garden river stone".split(), "de": "der die und das haus baum fluss".split()}
    out = []
    for i in range(n):
        text = [r.choice(words["en" if i % 3 else "de"]) for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.3)
        for _ in range(toxic * r.randint(1, 4)):
            text.insert(r.randrange(len(text)), r.choice(BAD) + r.choice(("", "s", "ing")))
        out.append((i, " ".join(text), toxic))
    return out


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


SMALL = T.Settings(epochs=4, buckets=1 << 12)


def test_held_out_accuracy():
    train, test = corpus(500, 1), corpus(300, 2)
    m = T.fit_model([t for _, t, _ in train], [y for *_, y in train], SMALL)
    reader = T.Reader(m)
    score, y = np.array([reader.score(t) for _, t, _ in test]), np.array([y for *_, y in test])
    assert auc(score, y) > 0.97
    assert ((score >= 0.3) == y).mean() > 0.93


def test_same_fit_again_and_memory_limit():
    train = corpus(200, 3)
    a, b = (T.fit_model([t for _, t, _ in train], [y for *_, y in train], SMALL) for _ in range(2))
    texts = [t for _, t, _ in corpus(50, 4)]
    assert [T.Reader(a).score(t) for t in texts] == [T.Reader(b, remembered=5).score(t) for t in texts]


def test_long_text_in_runs(monkeypatch):
    train = corpus(200, 5)
    m = T.fit_model([t for _, t, _ in train], [y for *_, y in train], SMALL)
    text = " ".join(t for _, t, y in corpus(400, 6) if not y)
    late = text + " nastix meanort grobvile"
    whole = [T.Reader(m).score(x) for x in (text, late)]
    monkeypatch.setattr(T, "RUN", 97)
    assert np.allclose(whole, [T.Reader(m).score(x) for x in (text, late)])
    assert whole[1] > whole[0]


def test_degenerate_fits():
    for labels, low in ((), True), ((0, 0), True), ((1, 1), False):
        m = T.fit_model(["a b", "c"][: len(labels)], list(labels), SMALL)
        s = T.Reader(m).score("a b")
        assert 0 <= s <= 1 and (s < 0.3) == low


def test_language_from_text():
    assert T.LANGUAGES[T.language("the cat and the dog".split())] == "en"
    assert T.LANGUAGES[T.language("der hund und die katze".split())] == "de"
    assert T.language([]) == -1


def test_spark_fit_and_scores(spark):
    rows = corpus(240, 7)
    docs = spark.createDataFrame([(i, t, "s", 9.0) for i, t, _ in rows] + [(900, None, "s", 0.0), (901, "", "s", 0.0), (901, "", "s", 0.0), (None, "x y", "s", 0.0), (902, "word " * 80_000, "s", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(900, 0, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    m = T.fit(docs, labels, settings=SMALL)
    out = T.score_documents(docs, m)
    assert set(out.columns) == {"doc_id", "text", "source", "score", "predicted"} and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[900].score == got[901].score
    y = np.array([y for *_, y in rows])
    assert auc(np.array([got[i].score for i, *_ in rows]), y) > 0.97
    assert T.score_documents(docs.limit(0), m).count() == 0
    assert T.fit(docs.limit(0), labels, settings=SMALL).thresholds == {}


def plain_score(m, text):
    """The convolution over all places, written out."""
    words = T.WORD.findall(text.lower())
    vectors = [m.table[T.word_hashes(w, m.settings.buckets)].sum(0) for w in words]
    features = []
    for kernel, bias in zip(m.kernels, m.bias):
        for f in range(m.settings.filters):
            at = [sum(vectors[i + j] @ kernel[j][:, f] for j in range(len(kernel))) + bias[f] for i in range(len(words) - len(kernel) + 1)]
            features.append(max([0.0, *at]))
    z = np.array(features) @ m.out + m.out_bias
    return m.score(np.array([z]), np.array([T.language(words)]))[0]


def test_scores_are_those_of_a_plain_convolution():
    train = corpus(200, 7)
    m = T.fit_model([t for _, t, _ in train], [y for *_, y in train], SMALL)
    reader = T.Reader(m)
    for text in ["", "one", "two words", *[t for _, t, _ in corpus(40, 8)]]:
        assert abs(reader.score(text) - plain_score(m, text)) < 1e-5


def test_fit_learns_from_all_of_a_long_text():
    """Toxic words stand late in long texts; no clean words of such texts are learned as toxic."""
    r = random.Random(9)
    words = "the of and to in is garden river stone".split()
    rows = [(" ".join([*(r.choice(words) for _ in range(3_000)), *(["nastix"] * (i % 4 == 0))]), int(i % 4 == 0)) for i in range(80)]
    m = T.fit_model([t for t, _ in rows], [y for _, y in rows], SMALL)
    reader = T.Reader(m)
    clean, late = [reader.score(" ".join(r.choice(words) for _ in range(5_000)) + x) for x in ("", " nastix")]
    assert clean < 0.3 <= late


def test_sample_is_bounded_in_words():
    s = T.Settings(epochs=1, buckets=1 << 10, sample_words=100)
    long = ["nastix " * 90, "word " * 90, "word " * 5]
    m = T.fit_model(long, [1, 0, 0], s)  # the second would go over the bound
    n = T.fit_model([long[0], long[2]], [1, 0], s)
    assert np.array_equal(m.out, n.out) and m.thresholds == n.thresholds
