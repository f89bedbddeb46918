"""Every query with SQL against DuckDB on the smallest tables."""

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
from affinade.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = importlib.util.find_spec("affinade.llm") is not None


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    show = lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[c]) for c in sorted(columns)) for r in rows)


QUICK = [n for n in ORACLE_SQL if n not in ("regression_topk", "regression_explain", "rwr_mass")]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert plain([r.asDict() for r in df.collect()], df.columns) == plain(rows, want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert ("pipeline" in entry.queries()) == LLM
