"""Every registered query against its DuckDB oracle (the driver's gate) on
the smallest scale, plus a run of the rows-only queries."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(spark, con, key, QUERIES[key], ORACLES[key], SF_SMALL)
    assert ok, msg


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["model_id", "epoch", "cost_train", "cost_val", "acc_val", "sqe_val"]
