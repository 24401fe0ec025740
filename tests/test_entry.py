"""The driver's contract: every query with SQL agrees with DuckDB; the language-model part may be gone."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


def value(x):
    return round(float(x), 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(str([value(r[c]) for c in columns]) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(str([value(r[i]) for i in place]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_language_model_part(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "gleaner"), tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hamming_pairs' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_workers_find_the_package_from_anywhere(tmp_path):
    """A driver that only has the checkout on sys.path, started in another folder."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {here!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.queries()['hamming_pairs'](s, {DIR!r}).count() > 0"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_all_lines_link_parts(spark, tmp_path):
    """Small quantities and parts between an order's least and greatest count; a null key links nothing."""
    lines = [(1, 5, 1.0), (1, 7, 50.0), (1, 9, 2.0), (2, 7, 3.0), (2, 2, 4.0), (3, 20, 1.0), (3, 21, 1.0), (4, 30, 50.0), (None, 30, 1.0), (None, 2, 1.0), (3, None, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["node"]: r["component"] for r in entry.queries()["linked_parts"](spark, str(tmp_path)).collect()}
    assert got == {2: 2, 5: 2, 7: 2, 9: 2, 20: 20, 21: 20}
