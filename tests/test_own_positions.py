"""Orders that are the intents of the trades find their positions in one pass."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from barloom.operators import positions as P
from helpers import d


def test_own_positions_equal_positions_at(spark):
    rows = [("t1", 1, "A", "2026-01-05", "buy", 300), ("t2", 1, "A", "2026-01-05", "sell", 500),
            ("t3", 1, "A", "2026-01-31", "buy", 900), ("t4", 1, "A", "2026-02-01", "sell", 100),
            ("t5", 1, "A", "2026-03-02", "buy", 200), ("t6", 1, "A", "2026-03-02", "hold", 100),
            ("t7", None, "A", "2026-03-02", "buy", 100), ("t8", None, "A", "2026-04-02", "sell", 50),
            ("t9", 2, "B", "2026-03-02", "sell", 100)]
    trades = spark.createDataFrame([(*r[:3], d(r[3]), *r[4:]) for r in rows],
                                   "trade_id string, account int, symbol string, trade_date date, "
                                   "side string, shares long")
    on = F.date_add("trade_date", F.when(F.col("shares") % 900 == 0, 1).otherwise(0))
    orders = trades.withColumnRenamed("trade_id", "order_id").withColumn("trade_date", on)
    names = ["order_id", "account", "symbol", "trade_date"]
    want = P.positions_at(orders, trades).join(orders.select("order_id", "side", F.col(
        "shares").alias("asked")), "order_id").select(
        *names, "side", "asked", "shares", "locked_shares")
    got = P.own_positions(trades, on).select(*names, "side", "shares", "held", "locked")
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(map(tuple, want.collect()))
    assert [r[6] for r in found] == [0, 300, 900, 900, 800, 1000, 0, 100, 0]


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("+- Exchange hashpartitioning") + plan.count(":- Exchange hashpartitioning")


def test_trades_are_shuffled_once(spark, sf):
    """Lines meet their orders once, and moves and slices share what is written."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan shows what is reused
    try:
        assert shuffles(queries()["positions_at"](spark, sf)) <= 5
        assert shuffles(queries()["order_screen"](spark, sf)) <= 12
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
