"""Every registered query beside its SQL, on the smallest tables."""

import duckdb
import pytest

import check
from murmur.plans import catalog

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    status, _, _, note = check.compare(
        spark, name, catalog.QUERIES[name], catalog.ORACLES.get(name), sf, con
    )
    assert status in ("ok", "rows-only"), note


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(set(catalog.QUERIES) - set(entry.oracle_sql())) <= 1


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 80
