"""Registered queries against their SQL twins. A spread of families runs by
default; set TIDEBOOK_ALL=1 to run every query."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

ROOT = "/root/testdata/sf0.001"
SAMPLE = ["ded03", "prj05", "join05", "join09", "agg05", "agg19", "win07", "win18", "win24", "win25", "win30", "pat02", "pat06", "pat13", "opt05", "opt07", "opt12",
          "opt16_", "bkt01", "bkt04", "bkt05", "bkt06", "mf04", "mf11", "fb02_", "fb05", "ml07", "dq03", "rpt03", "src02", "src05", "str06_"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return c


def test_registry_loads_in_a_fresh_process_without_a_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and SparkContext._active_spark_context is None; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) >= 190, done.stderr


def test_every_query_has_a_callable_and_oracles_are_a_subset():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 190 and all(callable(f) for f in q.values())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if os.environ.get("TIDEBOOK_ALL") or any(n.startswith(s) for s in SAMPLE)])
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
