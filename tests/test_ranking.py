import math

import pytest

from barloom.operators import bars as B
from barloom.operators import ranking as R
from helpers import bars_df, d, random_walk, rows


def scores_df(spark, data):
    return spark.createDataFrame([(s, d(t), float(v)) for s, t, v in data],
                                 "symbol string, trade_date date, score double")


def test_rank_ties_go_by_symbol(spark):
    df = scores_df(spark, [("B", "2026-01-05", 1), ("A", "2026-01-05", 1), ("C", "2026-01-05", 2),
                           ("A", "2026-01-06", 0)])
    assert rows(R.daily_rank(df), "trade_date", "rank", "symbol", "rank_strength") == [
        (d("2026-01-05"), 1, "C", 1.0), (d("2026-01-05"), 2, "A", 0.6667),
        (d("2026-01-05"), 3, "B", 0.3333), (d("2026-01-06"), 1, "A", 1.0)]
    top = R.top_k_targets(df, 2, 0.5, 0.3)
    assert rows(top, "trade_date", "symbol", "target_weight") == [
        (d("2026-01-05"), "A", 0.3), (d("2026-01-05"), "C", 0.3), (d("2026-01-06"), "A", 0.3)]


def ordinal_ic(pairs):
    """pairs: (symbol, x, y); ordinal ranks, ties by symbol."""
    pairs = sorted(pairs)
    def ranks(values):
        order = sorted(range(len(values)), key=lambda i: (values[i], i))
        out = [0] * len(values)
        for position, i in enumerate(order):
            out[i] = position
        return out
    rx, ry = ranks([p[1] for p in pairs]), ranks([p[2] for p in pairs])
    n, m = len(pairs), (len(pairs) - 1) / 2
    cov = sum((a - m) * (b - m) for a, b in zip(rx, ry))
    return cov / math.sqrt(sum((a - m) ** 2 for a in rx) * sum((b - m) ** 2 for b in ry))


def test_rank_ic_equals_brute_force(spark):
    data = [(f"S{i}", "2026-01-05", (i * 7) % 5, (i * 3) % 4) for i in range(9)]
    data += [(f"S{i}", "2026-01-06", i, -i) for i in range(4)]
    data += [(f"S{i}", "2026-01-07", i, i) for i in range(2)]  # too few pairs
    df = spark.createDataFrame([(s, d(t), float(x), float(y)) for s, t, x, y in data],
                               "symbol string, trade_date date, score double, label double")
    got = dict(rows(R.rank_ic_by_date(df), "trade_date", "ic"))
    want = {d(t): ordinal_ic([(s, x, y) for s, u, x, y in data if u == t])
            for t in ("2026-01-05", "2026-01-06")}
    assert got == pytest.approx(want)
    assert R.rank_ic(df).first().rank_ic == pytest.approx(sum(want.values()) / 2)


def test_momentum_argmax_slice(spark):
    bars = bars_df(spark, [
        ("000001.SZ", "2026-07-28", 9.9, 10.1, 9.8, 10.0, 100000, 1000000),
        ("000001.SZ", "2026-07-29", 10.1, 10.6, 10.0, 10.5, 120000, 1250000),
        ("600000.SH", "2026-07-28", 11.9, 12.1, 11.8, 12.0, 90000, 1080000),
        ("600000.SH", "2026-07-29", 12.2, 13.3, 12.1, 13.2, 150000, 1950000)])
    universe = spark.createDataFrame([("000001.SZ", True), ("600000.SH", False)],
                                     "symbol string, eligible boolean")
    assert rows(R.momentum_argmax(bars, universe), "symbol") == [("000001.SZ",)]
    assert rows(R.momentum_argmax(bars), "symbol") == [("600000.SH",)]


def test_latest_two(spark):
    bars = bars_df(spark, random_walk(["000001.SZ"], 5) + random_walk(["600000.SH"], 1))
    got = B.latest_two(bars).orderBy("symbol").collect()
    assert (str(got[0].last_date), str(got[0].second_date)) == ("2026-01-09", "2026-01-08")
    assert got[1].second_date is None


def test_recommendations(spark):
    ranks = R.daily_rank(scores_df(spark, [(s, "2026-01-06", v) for s, v in
                                           (("000001.SZ", 4), ("000002.SZ", 3),
                                            ("000003.SZ", 2), ("000004.SZ", 1))]))
    held = spark.createDataFrame([("000001.SZ", 0), ("000003.SZ", 100)],
                                 "symbol string, locked_shares long")
    latest = spark.createDataFrame(
        [("000001.SZ", d("2026-01-06"), 11.0, d("2026-01-05"), 10.0),
         ("000002.SZ", d("2026-01-06"), 10.0, d("2026-01-05"), 10.0),
         ("000003.SZ", d("2026-01-05"), 9.0, d("2026-01-04"), 10.0),
         ("000004.SZ", d("2026-01-06"), 10.0, None, None)],
        "symbol string, last_date date, last_close double, second_date date, second_close double")
    rules = spark.createDataFrame([("main", "normal", 100, 0.1)],
                                  "board string, security_status string, lot_size int, "
                                  "price_limit_pct double")
    got = {r.symbol: r for r in R.recommend(ranks, held, latest, rules, "2026-01-06",
                                            "2026-01-06", 2).collect()}
    assert [got[f"00000{i}.SZ"].recommendation for i in (1, 2, 3, 4)] == [
        "HOLD", "BUY", "SELL", "WATCH"]
    assert (got["000002.SZ"].band_low, got["000002.SZ"].band_high) == (9.8, 10.0)
    assert got["000001.SZ"].risk_notes == ["NEAR_LIMIT_UP"]
    assert got["000003.SZ"].risk_notes == ["NO_BAR_ON_SIGNAL_DATE", "VALUATION_FROZEN_NO_BAR",
                                           "NEAR_LIMIT_DOWN", "T1_LOCKED_SHARES"]
    assert got["000004.SZ"].risk_notes == [] and got["000004.SZ"].band_low is None
