"""Queries whose tasks would grow with the table begin with many partitions of their own."""

from __spark_entry__ import queries
from barloom.session import wide_session

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_wide_session_leaves_the_caller_alone(spark):
    wide = wide_session(spark)
    assert int(wide.conf.get(INITIAL)) == 16 * spark.sparkContext.defaultParallelism
    assert wide.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get(INITIAL, None) is None


def test_named_queries_use_it(spark, sf):
    for name in ("daily_factor_alignment", "positions_at", "order_screen"):
        assert queries()[name](spark, sf).sparkSession.conf.get(INITIAL, None), name
