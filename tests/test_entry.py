import os

import duckdb
import pytest

import __spark_entry__ as entry
from clausewright.plans import all_queries, all_sql

ROOT = "/root/testdata/sf0.001"
CORE = sorted(all_queries())


def value(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(ROOT):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{ROOT}/{name}')")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "key", "score", "rank"] and df.count() > 0


def test_names():
    assert set(all_sql()) <= set(CORE) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_core_query_matches_sql(spark, sql, name):
    df = all_queries()[name](spark, ROOT)
    rows = df.collect()
    if name not in all_sql():
        assert rows and len(set(df.columns)) == len(df.columns) and len({str(r) for r in rows}) > 1
        return
    rel = sql.sql(all_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [rel.columns.index(c) for c in order]
    assert sorted(tuple(value(r[c]) for c in order) for r in rows) == sorted(tuple(value(r[i]) for i in at) for r in rel.fetchall())
