"""Every registered query runs on the smallest tables and equals its SQL.

Queries of the text operators are tested with them.
"""

import pytest

import __spark_entry__ as entry
from barloom import workload
from parity import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_a_check():
    assert set(workload.QUERIES) == set(workload.ORACLES)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    ok, note = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["symbol", "trade_date", "score", "rank", "target_weight",
                           "rank_strength"]
    assert out.count() > 0
