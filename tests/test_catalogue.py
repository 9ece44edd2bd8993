"""Queries against their SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rostra.plans import core, files, golden, more

QUERIES = core.QUERIES | more.QUERIES | golden.QUERIES | files.QUERIES
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>", "nan"):
        return "None"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n, (_, s) in QUERIES.items() if s])
def test_against_sql(spark, sql, name):
    run, text = QUERIES[name]
    ours, theirs = run(spark, DATA).toPandas(), sql.sql(text).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [n for n, (_, s) in QUERIES.items() if not s])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
