"""Every registered query against its DuckDB oracle on the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from pricelens.sources.tables import TABLES
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_query_matches_oracle(spark, con, key):
    sql = E.oracle_sql().get(key)
    msg = compare(spark, con, key, E.queries()[key], sql, SF)
    assert " OK " in msg or "(no oracle)" in msg, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "drop_pct" in df.columns
