"""Full text and the merge of all tables against the same rules in plain Python."""

import random
import re

import pytest
from fairground.operators import fulltext, rekeying

EVENT = "event_id long, title string, short_description string, description string, genres array<string>"


def test_matches_equal_a_scan(spark):
    rng = random.Random(4)
    vocabulary = ["łódź", "jazz", "Jazz", "night", "open-air", "a", "the", "2026", "été", "ete", "зима", "lodz"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))
    rows = [(i, some(3), some(3) or None, "the " * 50 + some(30), [some(2), None, some(2)]) for i in range(200)]
    queries = [(i, some(5)) for i in range(60)] + [(100, None), (101, "  ,"), (102, "nowhere jazz"), (103, "the THE the")]
    plain = {"ł": "l", "ó": "o", "ź": "z", "é": "e"}
    split = lambda t: {w for w in re.split(r"[^\w]+", "".join(plain.get(c, c) for c in (t or "").lower())) if w}
    want = set()
    for q, text in queries:
        words = split(text)
        for i, title, short, long, genres in rows:
            fields = [("A", split(title)), ("B", split(short) | split(" ".join(g for g in genres if g))), ("C", split(long))]
            if words and words <= set().union(*(f for _, f in fields)):
                want.add((q, i, len(words), next(k for k, f in fields if words & f)))
    index = fulltext.postings(spark.createDataFrame(rows, EVENT))
    got = {tuple(r) for r in fulltext.matches(index, spark.createDataFrame(queries, "query_id long, text string")).collect()}
    assert got == want and {k for *_, k in want} == {"A", "B", "C"}
    for text in ("the open air", "Łódź", "", "nowhere"):
        one = {(0, r.event_id, r.strongest) for r in fulltext.search(index, text).collect()}
        assert one == {(q, i, k) for q, i, _, k in (tuple(r) for r in fulltext.matches(index, spark.createDataFrame([(0, text)], "query_id long, text string")).collect())}


def test_queries_of_the_same_words_are_answered_once(spark, tmp_path):
    index = fulltext.postings(spark.createDataFrame([(i, "common word", None, None, None) for i in range(500)], EVENT))
    index.write.parquet(str(tmp_path / "index"))
    queries = spark.createDataFrame([(i, ["common word", "Word common"][i % 2]) for i in range(500)], "query_id long, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    found = fulltext.matches(spark.read.parquet(str(tmp_path / "index")), queries)
    assert found.agg({"event_id": "sum", "n_words": "max"}).count() == 1 and found.count() == 250_000
    assert written() - before < 80_000


def test_words_are_folded_and_counted(spark):
    got = fulltext.postings(spark.createDataFrame([(1, "Brașov, brasov!", None, None, None), (2, None, None, None, None)], EVENT)).collect()
    assert [tuple(r) for r in got] == [("brasov", 1, "A", 2)]


def in_turn(pairs, rows, rule, columns):
    """Duplicates merged one by one in the order of their ids, rows as dicts."""
    ends = dict(pairs)

    def end(e):
        while e in ends:
            e = ends[e]
        return e

    touched = {end(d) for d in ends}
    rows = sorted((dict(r) for r in rows), key=lambda r: (r["event_id"] in ends, r["event_id"], r.get("id", 0)))
    if rule.unique is None:
        return [{**r, "event_id": end(r["event_id"])} for r in rows]
    out, rest = {}, [r for r in rows if end(r["event_id"]) not in touched]
    for r in rows:
        e = end(r["event_id"])
        if e not in touched:
            continue
        key = (e, *[r[u] for u in rule.unique])
        if key not in out:
            out[key] = {**r, "event_id": e}
            continue
        had = out[key]
        for c in columns:
            how, a, b = rule.columns.get(c, "own"), had[c], r[c]
            if how == "first":
                had[c] = b if a is None else a
            elif how == "last":
                had[c] = a if b is None else b
            elif how == "any":
                had[c] = None if a is None and b is None else bool(a or b)
            elif how == "greatest":
                had[c] = max((v for v in (a, b) if v is not None), default=None)
            elif how == "longest":
                had[c] = b if len(b or "") > len(a or "") else a
    return [*rest, *out.values()]


@pytest.mark.parametrize("unique", [None, ("spot",), ()])
def test_rekeyed_equals_one_merge_after_the_other(spark, unique):
    rng = random.Random(7)
    rows = [{"event_id": rng.randrange(30), "id": i, "spot": rng.choice([None, 1, 2]), "a": rng.choice([None, 1, 2, 3]), "b": rng.choice([None, 1, 2, 3]), "c": rng.choice([None, True, False]), "d": rng.choice([None, 5, 6]), "t": rng.choice([None, "x", "yy", "zz"])} for i in range(200)]
    if unique == ():
        rows = list({r["event_id"]: r for r in rows}.values())
    pairs = [(d, d - 1) for d in range(30) if d % 5 in (1, 2, 3)] + [(24, 10)]
    rule = rekeying.Rule(unique, {"a": "first", "b": "last", "c": "any", "d": "greatest", "t": "longest"}, "id")
    schema = "event_id long, id long, spot int, a int, b int, c boolean, d int, t string"
    names = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = rekeying.merge_everywhere(spark.createDataFrame(pairs, "duplicate long, event_id long"), {"x": df}, {"x": rule})["x"]
    order = lambda rs: sorted(rs, key=str)
    assert got.columns == names
    assert order(tuple(r) for r in got.collect()) == order(tuple(r[n] for n in names) for r in in_turn(pairs, rows, rule, names[1:]))


def test_circles_raise_and_loops_are_none(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "duplicate long, event_id long")
    with pytest.raises(ValueError, match="circle"):
        rekeying.resolved(pairs((1, 2), (2, 3), (3, 1)))
    assert rekeying.resolved(pairs((1, 1))).count() == 0
    assert sorted(map(tuple, rekeying.resolved(pairs(*[(i + 1, i) for i in range(50)])).collect())) == [(i + 1, 0) for i in range(50)]
