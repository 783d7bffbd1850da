"""The suspension records that the queries read: days without a trade, laid out after the join."""

from pyspark.sql import functions as F

from barloom.workload import fixtures as T


def test_days_without_trades_as_an_anti_join(spark, sf):
    k = F.col("k")
    pick = (k + F.dayofyear("trade_date")) % 5
    every = T.instruments(spark, sf).select("k", F.explode(F.sequence(
        T.day(T.FIRST_DAY), T.day(T.LAST_DAY))).alias("trade_date"))
    want = every.where(pick < 4).exceptAll(every.where(pick < 4).join(
        T.ticks(spark, sf).select("k", "trade_date"), ["k", "trade_date"], "left_semi")).select(
        T.symbol_of(k).alias("ts_code"), "trade_date",
        F.when(pick < 3, "S").otherwise("R").alias("suspend_type"))
    got = T.suspensions(spark, sf).drop("suspend_timing")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("suspend_type = 'R'").count() > 0


def test_no_row_per_day_is_shuffled(spark, sf, capsys):
    T.suspensions(spark, sf).explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and "Exchange" not in plan[:plan.index("Generate explode")]
