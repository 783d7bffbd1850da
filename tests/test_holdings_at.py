"""Accounts are valued from one pass over the trades, which meet their orders once."""

import random
import re
from datetime import timedelta

from pyspark.sql import functions as F

from __spark_entry__ import queries
from barloom.operators import positions as P
from barloom.operators import prices as M
from helpers import bars_df, d


def made(spark):
    rng = random.Random(4)
    rows = [(f"t{i:03d}", rng.choice([1, 2]), rng.choice("ABC"),
             None if i % 40 == 7 else d("2026-01-01") + timedelta(days=rng.randrange(200)),
             rng.choice(["buy", "sell", "sell"]), rng.randrange(0, 9)) for i in range(300)]
    trades = spark.createDataFrame(rows, "trade_id string, account bigint, symbol string, "
                                   "trade_date date, side string, shares bigint").withColumn(
        "gross", F.col("shares").cast("decimal(20,2)"))
    days = spark.createDataFrame([(d("2026-03-10"),), (d("2026-03-20"),), (d("2026-06-30"),)],
                                 "trade_date date")
    return trades, days


def test_holdings_at_days_equal_the_last_ones_of_a_scan(spark):
    trades, days = made(spark)
    ledger = P.holdings_over_time(trades).collect()
    want, ends = {}, sorted(r.trade_date for r in days.collect())
    for r in sorted((r for r in ledger if r.trade_date), key=lambda r: (r.trade_date, r.seq)):
        if r.trade_date <= ends[-1]:
            want[r.account, r.symbol, min(e for e in ends if e >= r.trade_date)] = r.held
    got = P.holdings_at(trades, days, P.cash_flow(None)).collect()
    assert {(r.account, r.symbol, r.day): r.held for r in got} == want and len(got) > 10


def test_both_forms_give_the_same_nav(spark):
    trades, days = made(spark)
    bars = bars_df(spark, [(s, t, 1, 1, 1, c, 1, 1) for s, t, c in (
        ("A", "2026-01-05", 3), ("A", "2026-04-01", 5), ("B", "2026-03-15", 7))])
    cash = spark.createDataFrame([(1, 100), (2, 0), (3, 5)], "account bigint, cash bigint").select(
        "account", F.col("cash").cast("decimal(20,2)").alias("cash"))
    flows = trades.select("account", "trade_date", P.cash_flow(None).alias("flow"))
    apart = M.account_nav(P.holdings_over_time(trades), flows, cash, bars, days)
    at_once = M.account_nav(P.holdings_at(trades, days, P.cash_flow(None)), None, cash, bars, days)
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, apart.collect()))
    assert at_once.count() == 9


def test_trades_meet_their_orders_once(spark, sf):
    plan = queries()["account_nav"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("o_custkey#\\d+L? AS account", plan)) == 1
