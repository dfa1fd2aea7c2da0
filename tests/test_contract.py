"""The driver's contract, and every query with SQL against that SQL on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from codexlake.plans import registry

OWN = {n: q for n, q in entry.oracle_sql().items() if n in registry.QUERIES}


@pytest.fixture(scope="module")
def views(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None or r[i] != r[i] else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_its_sql(name, spark, small, views):
    df = registry.QUERIES[name](spark, small)
    sql = views.sql(OWN[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert plain(df.columns, df.collect()) == plain(sql.columns, sql.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["table_name", "record_id", "parent_id", "child_id"]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(OWN)))
def test_rows_only_query_runs(name, spark, small):
    df = registry.QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_core_needs_no_subpackage_for_training_data():
    code = "import sys; sys.modules['codexlake.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q in ('p2_found', 'p9_found')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
