"""The sibling session reads the whole table, under the settings of its caller."""

from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.session import wide_session
from barloom.workload import fixtures as T


def test_every_setting_of_the_caller_is_kept(spark):
    for key, value in (("spark.sql.caseSensitive", "true"),
                       ("spark.sql.files.maxPartitionBytes", "4194304b")):
        before = spark.conf.get(key, None)
        spark.conf.set(key, value)
        try:
            assert wide_session(spark).conf.get(key) == value
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_no_key_is_left_out(spark, sf):
    def counted(session):
        factors = T.adj_factors(session, sf).withColumnRenamed("ts_code", "symbol")
        return sorted(map(tuple, Q.daily_factor_alignment(T.bars(session, sf), factors).collect()))

    wide = counted(wide_session(spark))
    assert wide == counted(spark)
    keys = T.bars(spark, sf).select("symbol", "trade_date").union(T.adj_factors(spark, sf).select(
        F.col("ts_code"), "trade_date")).distinct().count()
    assert sum(r[1] for r in wide) == keys
