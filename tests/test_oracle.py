"""Every registered query against its DuckDB oracle (sf0.001, whole tables)."""

import pytest

import __spark_entry__ as E
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
# the library's own queries; those of an optional subpackage have their tests there
NAMES = sorted(E._QUERIES)
# optimisers, which SQL cannot express: tested against brute force in
# test_exact_forecast.py and test_parallel_start.py
NO_SQL = {"forecast_exact", "fit_segments_parallel"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(NAMES) - NO_SQL <= set(SQL) and set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(NAMES) - NO_SQL))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()
    err = compare(got, want)
    assert err is None, err


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["offer_type", "success_rate"]
    assert df.count() >= 1
