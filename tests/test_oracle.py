"""Every registered query with SQL equals DuckDB on the same parquet tables (sf0.001).

The driver repeats this at sf0.01; here it runs on the smallest tables so the
whole catalogue is exercised by ``pytest``.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_harness import TABLES, rows_of

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield c
    c.close()


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) >= 70


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert rows_of(scols, srows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "ticket_type" in df.columns
