import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from fairground.llm.common import stored
from fairground.llm.queries import QUERIES, held_out

from .test_line_dedup import brute as brute_lines
from .test_ngram_join import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(3, 7)))
    passage = " ".join(word() for _ in range(90))
    rows = []
    for i in range(160):
        text = [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(r.randint(1, 3))]
        if i % 5 == 0:
            text.insert(0, "A banner line that many documents share")
        if i % 11 == 0:
            text.append("intro " + word() + " " + passage + " " + word())
        if i % 7 == 3:
            text.append("nastix meanort grobvile")
        rows.append((i, "\n".join(text), "en", "s", 1, "x"))
    rows += [(200 + i, rows[i][1] + " tail", "en", "s", 1, "y") for i in range(0, 40, 4)] + [(300, None, None, None, None, None), (301, "", "", "", 0, "")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, carried string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 3)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    clean = stored(stage["toxicity"](spark, docs, folder), "test")
    assert clean.columns == columns
    kept = {r.doc_id for r in clean.collect()}
    gone = set(range(160)) - kept
    toxic = {i for i in range(160) if i % 7 == 3}
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) <= 3 and {300, 301} <= kept

    lines = stage["line dedup"](spark, clean, folder)
    assert lines.columns == columns and sorted(pairs(lines), key=str) == sorted(((i, t) for i, _, _, t in brute_lines(pairs(clean))), key=str)

    lines = stored(lines, "test")
    single = stage["n-gram Jaccard join"](spark, lines, folder)
    want = {c for _, c, _ in brute_groups(pairs(lines))}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(want)

    single = stored(single, "test")
    cut = stored(stage["suffix-array dedup"](spark, single, folder), "test")
    assert cut.columns == columns and cut.count() == single.count()
    assert sum(len(t) for _, t in pairs(cut)) < sum(len(t or "") for _, t in pairs(single))

    packed = stage["packing"](spark, cut, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in pairs(cut)}
    total = {r.doc_id: r.doc_tokens for r in packed}
    assert sum(r.length for r in packed) == sum(total.values())


def test_run_and_clashing_columns(spark, folder):
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in QUERIES
    assert corpus_pipeline.run(spark, folder).count() > 0
    odd = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "1 as score", "2 as predicted", "3 as n_lines", "4 as kept", "5 as n_bytes", "6 as root", "7 as row", "8 as id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        assert {tuple(r)[2:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}, name


def test_held_out_fold(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id"))).collect()
    assert [r[1] for r in got] == [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in got]
    assert 20 < np.sum([r[1] for r in got]) < 80


def test_empty_repeated_and_very_long(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60_000))
    tables = {"empty": [], "odd": [(1, long, None, None, None), (2, "same text " * 30, None, None, None), (2, "same text " * 30, None, None, None), (3, None, None, None, None), (4, "", None, None, None)]}
    for name, rows in tables.items():
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        ids = {x.doc_id for x in got}
        assert ids == {i for i, *_ in rows}
        whole = sum(x.length for x in got if x.doc_id == 1)
        assert whole == max([x.doc_tokens for x in got if x.doc_id == 1], default=0)
    assert corpus_pipeline.run(spark, at).where("doc_id = 1").agg(F.max("doc_tokens")).first()[0] > 60_000
