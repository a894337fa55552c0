"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pytest

from check import compare
from jobmill.plans.catalog import ORACLES, QUERIES
from jobmill.plans.inputs import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    report = compare(spark, sf_dir, name, duck)
    assert report.startswith(("ok", "rows")), report


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows_and_a_stable_schema(spark):
    from __spark_entry__ import entry

    first, second = entry(spark), entry(spark)
    assert first.schema == second.schema and first.count() > 0
