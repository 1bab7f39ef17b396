"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import math
import os

import __spark_entry__ as entry_module
import pytest
from tessera.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([normal(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([normal(dict(zip(names, row, strict=True))[c]) for c in columns]) for row in cursor.fetchall())
    assert got == want


def test_entry_module(spark):
    assert entry_module.entry(spark).columns == ["key", "count"]
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(plans.QUERIES) <= set(queries)


def test_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    shutil.copytree(os.path.join(root, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wordcount_count' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
