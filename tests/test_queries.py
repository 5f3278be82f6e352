"""Every query with an SQL twin gives the twin's rows; the others give rows."""

import pytest

import __spark_entry__ as contract
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["cohort", "bin_lo", "period", "n", "churned", "churn_rate"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
