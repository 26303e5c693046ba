import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairground.llm import pii
from fairground.llm.queries import op13_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, spans string, row string"


def holds(kind, s):
    digits = [int(c) for c in re.sub("[^0-9]", "", s)]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(n, m.start(), m.end()) for n, (k, p) in enumerate(PATTERNS.items(), 1) for m in re.finditer(p, text) if holds(k, m.group())]


TEXTS = [
    "a@b.c@d.e.f x+y%z@mail.example.com. @no.one a@b a@-.-",
    "1.2.3.4.5.6.7.8.9 300.1.1.1 1.1.1.0255 001.002.003.004 1..2.3.4 9.9.9",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 42 4222222222222 4111 1111 1111 11119",
    "+1 (499) 555-6503 +1 2 +12345678 +123456789- +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6 ++49 30 1234567",
    "é+33 1 23 45 67 89é ٣٤٥ ４５６ ١@x.y a\x00@b.c",
    "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == plain(text)


@given(st.text(alphabet="01259ab@.+-() %é", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_equals_patterns_on_random_texts(text):
    assert pii.base_spans(text) == plain(text)


@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111", "1.2.3.4", "+1 (499) 555-6503", "a@b.c", " ", "-", ".", "x", "@", "+", "255", "256"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_base_equals_patterns_on_joined_parts(parts):
    assert pii.base_spans("".join(parts)) == plain("".join(parts))


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 1_000_000 + "1", "1" * 1_000_000, "1." * 500_000, "@" * 300_000, "a@" * 300_000, "+1" * 300_000, "a-@" * 200_000, "+1 " + "- " * 500_000):
        tokens = pii.Tokens()
        tokens.add(0, text, pii.base_spans(text))
    assert time.time() - began < 60


def small_field(seed=1):
    rng = np.random.default_rng(seed)
    same = rng.normal(size=(5, 5))
    like = rng.normal(size=(5, 5))
    return pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)), same + same.T, like + like.T)


def exact(tokens, field):
    """Marginals by summing over all labellings."""
    n = len(tokens.given)
    own = pii._feature_matrix(tokens.features) @ field.unary
    total = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        if any(g and g != y for g, y in zip(tokens.given, labels)):
            continue
        score = sum(0.0 if tokens.given[i] else own[i, y] for i, y in enumerate(labels))
        for edges, w in ((tokens.chain, field.chain), (tokens.same, field.same), (tokens.similar, field.similar)):
            score += sum(w[labels[a], labels[b]] for a, b in edges)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def tokens_of(*texts):
    tokens = pii.Tokens()
    for i, t in enumerate(texts):
        tokens.add(i, t, pii.base_spans(t))
    return tokens


def test_messages_are_exact_on_trees():
    tokens = tokens_of("12345 67890 and 12345 x 1.2.3.4 y 77777 88888", "99999")
    assert tokens.chain and tokens.same
    assert np.allclose(pii.marginals(tokens, small_field(), 200), exact(tokens, small_field()), atol=1e-6)


def test_messages_come_close_on_loops():
    tokens = tokens_of("12345 67890 and 12345 67890 12345")
    assert len(tokens.chain) + len(tokens.same) > len(tokens.given) - 1
    field = small_field()
    weak = pii.Field(field.unary, 0.3 * field.chain, 0.3 * field.same, 0.3 * field.similar)
    assert np.abs(pii.marginals(tokens, weak, 60) - exact(tokens, weak)).max() < 0.05


def test_links_grow_with_the_text():
    tokens = tokens_of("12345678 " * 1000)
    assert len(tokens.same) == 999 and len(tokens.chain) == 999 and not tokens.similar


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


TOLD = [
    ("call +1 (499) 555-6503 today, or 1 (499) 555-6503 tomorrow", "phone", "1 (499) 555-6503"),
    ("mail zedrick.73@mail2.example.com and later zedrick.73@mail2 again", "email", "zedrick.73@mail2"),
    ("host 82.43.185.109 was down, so was 82-43-185-109 then", "ip", "82-43-185-109"),
    ("pay 4539578763621486 or ref 4539.5787.6362.1486 now", "card", "4539.5787.6362.1486"),
    ("pay 4539578763621486 or rather 578763621486 now", "card", "578763621486"),
]


@pytest.mark.parametrize("text,kind,copy", TOLD)
def test_repeats_get_the_label(spark, field, text, kind, copy):
    filler = " lorem ipsum" * 500
    found = pii.find(spark.createDataFrame([(1, text.replace(" or ", filler + " or ").replace(" later", filler + " later").replace(" so ", filler + " so "), "s", "r")], SCHEMA), field).first()
    told = {(s.kind, found.row.text[s.start : s.end]) for s in found.spans}
    assert (kind, copy) in told or any(k == kind and copy in t for k, t in told)


@pytest.mark.parametrize("text", ["number 1 (499) 555-6503 alone", "zedrick.73@mail2 alone", "82-43-185-109 alone", "in 2024, 12 of 365 days; order 10002000 and 10002000 again", "version 4.0.1 of 3.5"])
def test_shape_alone_is_nothing(spark, field, text):
    assert pii.find(spark.createDataFrame([(1, text, "s", "r")], SCHEMA), field).first().spans == []


def test_cases(spark, field):
    rows = [(1, None), (2, ""), (None, "a@b.example"), (3, "a@b.example"), (3, "a@b.example"), (4, "x" * 3_000_000 + " +1 (499) 555-6503"), (5, "1" * 100_000)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    out = pii.span_report(docs, field).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in out) == [
        (0, 1, 0, 0, 0, "email:0:11"), (1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 1, 0, 0, 0, "email:0:11"), (3, 1, 0, 0, 0, "email:0:11"), (4, 0, 0, 0, 1, "phone:3000001:3000018"), (5, 0, 0, 0, 0, ""),
    ]
    assert pii.span_report(docs.where("1 = 0"), field).count() == 0


def test_redaction_keeps_other_columns(spark, field):
    docs = spark.createDataFrame([(1, "to a@b.example and 1.2.3.4.", "s", "r"), (2, None, "s", "r")], SCHEMA)
    out = {r.doc_id: r for r in pii.redact(docs, field).collect()}
    assert out[1].text == "to [email] and [ip]." and out[2].text is None and out[1].spans == "s" and out[1].row == "r"


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "no such thing", "s", "r")], SCHEMA)
    assert pii.find(docs, pii.fit(docs)).first().spans == []


def test_query_base_equals_patterns(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op13_pii(spark, d).collect()
    assert len(out) == len(texts)
    for r in out:
        base = [(pii.KINDS[k - 1], a, z) for k, a, z in plain(texts[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest()
        assert {f"{k}:{a}:{z}" for k, a, z in base} <= set(r.spans.split(","))
