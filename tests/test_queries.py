"""Every query against its SQL in DuckDB, on the smallest tables."""

import decimal
import importlib.util
import os

import duckdb
import pytest

from turnmill import plans

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, oracle, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = oracle.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_every_query_without_sql_runs(spark):
    for name in set(plans.QUERIES) - set(plans.SQL):
        assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_a_session_and_lists_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())
    if importlib.util.find_spec("turnmill.llm") and importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in entry.queries()
    assert entry.entry(spark).count() > 0
