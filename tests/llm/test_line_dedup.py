import hashlib
import random
from collections import defaultdict

from fairground.llm import line_dedup
from fairground.llm.queries import line_dedup_sql


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "keep", 7) for i, t in rows], "doc_id long, text string, n_lines string, lines int")
    got = line_dedup.dedup_lines(df, **k)
    assert set(got.columns) == {"doc_id", "text", "n_lines", "lines", "n_dropped"}
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str)


LONG = "A line with more than twenty characters"
CASES = [
    (1, LONG + "\nshort\nown one"), (2, "  " + LONG.upper() + "\t\n\n"), (3, LONG + "\r\n" + LONG), (4, None), (5, ""), (6, "\n\n"), (7, LONG + "É"), (8, LONG + "é"),
    (None, LONG), (9, "x" * 300_000 + "\n" + LONG), (9, "x" * 300_000 + "\n" + LONG), (9, "another text of id nine, long enough\n" + LONG), (10, LONG), (10, LONG + "\nlast"), (11, "é" * 19), (12, "é" * 20), (13, "é" * 20), (14, " é" + "é" * 19),
]


def test_cases(spark):
    assert run(spark, CASES) == brute(CASES)


def test_random_lines(spark):
    r = random.Random(3)
    lines = [f"shared line number {i:03d} in many documents" for i in range(12)] + ["tiny", "", "  "]
    rows = [(i % 60, "\n".join(r.choice(lines) for _ in range(r.randint(0, 9)))) for i in range(90)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_chars=3, min_docs=5) == brute(rows, 3, 5)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_sql_says_the_same(spark):
    import duckdb
    import pandas as pd

    rows = [(i, t) for n, (i, t) in enumerate(CASES) if i is not None and i not in (9, 10)]
    con = duckdb.connect()
    con.register("docs", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = sorted(con.execute(line_dedup_sql("docs")).fetchall(), key=str)
    assert [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in got] == [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute(rows)]


def test_native_plan(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame(CASES, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_hot_lines_are_dealt(spark, monkeypatch):
    from fairground.llm import line_dedup as L

    rows = [(i, f"a line that stands in all documents\nown line of number {i}, which stays\na line of some documents {i % 20}") for i in range(120)]
    want = sorted((i, n, d, t) for i, n, d, t in brute(rows))
    for hot in (2, 1_000):
        monkeypatch.setattr(L, "HOT", hot)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(df).collect())
        assert got == want
