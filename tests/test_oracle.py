"""Every query that SQL can express equals its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import test_brute_force
from pairloom.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(t):
    names = sorted(t.column_names)
    return names, sorted(repr([plain(v) for v in r]) for r in zip(*[t.column(n).to_pylist() for n in names]))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toArrow()
    if name not in catalogue.SQL:
        assert f"test_{name}" in vars(test_brute_force), "a query without SQL needs a test of its own"
        return
    want = con.sql(catalogue.SQL[name])
    want = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.arrow()
    assert rows(got) == rows(want.read_all() if hasattr(want, "read_all") else want)


def test_entry_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert entry.entry(spark).columns == ["source_id", "critical", "expected", "corpus", "digests"]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
    assert done.returncode == 0 and done.stdout.split()[-1] == "True", done.stderr[-500:]


def test_workers_get_the_package(sf, tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nimport __spark_entry__ as e\n"
        f"s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', e.queries()['normalize_hash_documents'](s, {sf!r}).count(), e.entry(s).count() >= 0)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert done.returncode == 0 and "rows 100 True" in done.stdout, done.stderr[-800:]
