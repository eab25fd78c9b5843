"""Every registered query against its DuckDB twin (small scale factor; the
driver runs the same comparison at sf0.01, see tests/run_oracle.py)."""

import pytest

import __spark_entry__ as entry
from tickflow.plans.catalog import REGISTRY
from oracle_harness import compare, duck_connection

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck_connection(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_dir, con, name):
    r = compare(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_query_without_twin_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_source_fallback_takes_more_than_one_source(spark):
    rows = QUERIES["source_fallback"](spark, "/root/testdata/sf0.01").select("symbol", "source_priority").distinct().collect()
    assert len({r["source_priority"] for r in rows}) >= 2 and "5-LOW" not in {r["symbol"] for r in rows}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[0] == "symbol"
