"""Every registered query against its DuckDB oracle, on whole tables."""

import pytest

import __spark_entry__ as entry
from tests.harness import DATA, difference, duck, duck_rows, spark_rows

SF = f"{DATA}/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert difference(got, duck_rows(con, ORACLES[name])) == ""
    else:
        assert got[0]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
