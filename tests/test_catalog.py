"""Each query of the catalogue gives the rows of its SQL, and the entry module holds its contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from fairground.plans import catalog, catalog_more, catalog_rules, catalog_work  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert normal(got.columns, got.collect()) == normal(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, con, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_other_subpackage(tmp_path):
    shutil.copytree(ROOT / "fairground", tmp_path / "fairground", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith(('op1_', 'pipeline')) for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry(spark, con):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
