"""Every registered query with an oracle matches DuckDB at sf0.001."""

import pytest

import __spark_entry__ as E
from faultlens import queries as Q
from conftest import SF_SMALL
from oracle_check import compare, duck

NAMES = sorted(Q.ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, Q.QUERIES[name], Q.ORACLES[name], SF_SMALL)
    assert r["ok"], r.get("why")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["label", "n_windows"] and len(df.columns) == 2 + 5 * 11
    assert df.count() >= 1
