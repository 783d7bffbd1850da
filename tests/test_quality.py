import pytest
from pyspark.sql import functions as F

from barloom.operators import coverage as V
from barloom.operators import quality as Q
from helpers import bars_df, d, raw_df, rows

NAN, INF = float("nan"), float("inf")
BASE = dict(ts_code="000001.SZ", trade_date=d("2023-06-01"), open=10.0, high=11.0, low=9.0,
            close=10.5, vol=100.0, amount=100.0)
WINDOW = ("2023-06-01", "2023-10-31")


def judge(spark, *changes, requested=("000001.SZ",)):
    raw = raw_df(spark, [tuple({**BASE, **c}.values()) for c in changes])
    asked = spark.createDataFrame([(s,) for s in requested], "symbol string")
    return Q.normalize_bars(raw, asked, *WINDOW)


@pytest.mark.parametrize("change,code", [
    ({"open": 0.0}, "NON_POSITIVE_VALUE"), ({"high": -1.0}, "NON_POSITIVE_VALUE"),
    ({"low": NAN}, "NON_FINITE_VALUE"), ({"close": INF}, "NON_FINITE_VALUE"),
    ({"vol": -1.0}, "NEGATIVE_VALUE"), ({"amount": -1.0}, "NEGATIVE_VALUE"),
    ({"open": 8.0}, "INVALID_OHLC"), ({"close": 12.0}, "INVALID_OHLC"),
    ({"high": 8.0}, "INVALID_OHLC"),
    ({"open": 10.0, "high": 10.0, "low": 10.0, "close": 10.0, "amount": 80.0},
     "VWAP_OUTSIDE_OHLC_BAND"),
    ({"open": 10.0, "high": 10.0, "low": 10.0, "close": 10.0, "amount": 120.0},
     "VWAP_OUTSIDE_OHLC_BAND"),
    ({"vol": 0.0}, "INCONSISTENT_ZERO_TURNOVER"), ({"amount": 0.0}, "INCONSISTENT_ZERO_TURNOVER"),
    ({"trade_date": d("2023-05-31")}, "REQUEST_DATE_MISMATCH"),
    ({"trade_date": None}, "INVALID_TRADE_DATE"),
    ({"ts_code": "000002.SZ"}, "REQUEST_SYMBOL_MISMATCH"),
    ({"vol": 1e308}, "UNIT_CONVERSION_OVERFLOW"),
    ({"high": 1.75e308, "amount": 1e300, "vol": 1e305}, "VWAP_BOUND_OVERFLOW"),
    # two defects: the first in the order of the checks wins
    ({"ts_code": "000002.SZ", "open": 0.0}, "REQUEST_SYMBOL_MISMATCH"),
    ({"open": NAN, "vol": -1.0}, "NON_FINITE_VALUE"),
])
def test_defects(spark, change, code):
    valid, rejected = judge(spark, change)
    assert valid.count() == 0
    assert [r.reason_code for r in rejected.collect()] == [code]


def test_units_and_zero_turnover(spark):
    valid, rejected = judge(spark, {}, {"trade_date": d("2023-06-02"), "vol": 0.0, "amount": 0.0})
    assert rejected.count() == 0
    assert rows(valid, "volume", "amount") == [(0.0, 0.0), (10000.0, 100000.0)]


def test_duplicates_and_bad_symbols(spark):
    valid, rejected = judge(spark, {}, {"close": 10.0}, {"ts_code": "T1", "vol": 1.0},
                            requested=("000001.SZ", "T1"))
    assert valid.count() == 0
    assert sorted(r.reason_code for r in rejected.collect()) == [
        "DUPLICATE_DAILY_BAR", "DUPLICATE_DAILY_BAR", "INVALID_SYMBOL"]


def test_failfast(spark):
    raw = raw_df(spark, [tuple({**BASE, "open": 0.0}.values())])
    asked = spark.createDataFrame([("000001.SZ",)], "symbol string")
    with pytest.raises(Q.QualityError, match="NON_POSITIVE_VALUE"):
        Q.normalize_bars(raw, asked, *WINDOW, mode="failfast")


DAYS = [f"2026-07-{n}" for n in range(20, 25)]
BOTH = ("000001.SZ", "600000.SH")


def audit(spark, bar_keys, suspended=(), delisted=None, members=None, expected_members=2):
    bars = bars_df(spark, [(s, t, 1, 1, 1, 1, 1, 1) for s, t in bar_keys]).select(
        "symbol", "trade_date")
    susp = spark.createDataFrame([(s, d(t), None, k) for s, t, k in suspended],
                                 "ts_code string, trade_date date, suspend_timing string, "
                                 "suspend_type string")
    lives = spark.createDataFrame(
        [(s, d("2020-01-01"), d(delisted[s]) if delisted and s in delisted else None)
         for s in BOTH], "symbol string, listed_on date, delisted_on date")
    spans = members or [(s, DAYS[0], None) for s in BOTH]
    memberships = spark.createDataFrame(
        [(s, d(a), d(b) if b else None) for s, a, b in spans],
        "symbol string, valid_from date, valid_to date")
    days = spark.createDataFrame([(d(t),) for t in DAYS], "trade_date date")
    return V.audit_coverage(memberships, lives, days, bars, susp, DAYS[0], DAYS[-1],
                            expected_members)


def test_full_coverage_passes(spark):
    out = audit(spark, [(s, t) for s in BOTH for t in DAYS])["summary"].first()
    assert out.passed and out.expected_days == 10 and out.bar_days == 10 and out.sessions == 5


def test_delisting_day_needs_no_bar(spark):
    keys = [(BOTH[0], t) for t in DAYS[:2]] + [(BOTH[1], t) for t in DAYS]
    out = audit(spark, keys, delisted={BOTH[0]: DAYS[2]})
    row = out["summary"].first()
    assert (row.expected_days, row.bar_days, row.delisted_days, row.missing_days) == (8, 7, 1, 0)
    assert rows(out["delisted_in_scope"], "symbol") == [(BOTH[0],)]
    # the member count drops after the delisting
    assert rows(out["member_count_anomalies"], "trade_date", "actual_count") == [
        (d(DAYS[3]), 1), (d(DAYS[4]), 1)]


def test_precedence_of_evidence(spark):
    keys = [(s, t) for s in BOTH for t in DAYS if (s, t) != (BOTH[1], DAYS[2])]
    every = [(BOTH[0], DAYS[2], "S"), (BOTH[1], DAYS[2], "S"), (BOTH[1], DAYS[3], "R")]
    out = audit(spark, keys, every, delisted={s: DAYS[2] for s in BOTH})
    got = dict(((r.symbol, str(r.trade_date)), r["class"]) for r in out["classified"].collect())
    assert got[(BOTH[0], DAYS[2])] == "BAR"
    assert got[(BOTH[1], DAYS[2])] == "SUSPENDED"


def test_resumption_does_not_excuse_and_skips_are_found(spark):
    out = audit(spark, [(BOTH[0], t) for t in DAYS], [(BOTH[1], DAYS[0], "R")])
    row = out["summary"].first()
    assert row.reason_codes == ["MISSING_MEMBER_DAYS", "SILENT_MEMBER_SKIP"]
    assert rows(out["silent_skips"]) == [(BOTH[1], 5)]


def test_member_counts_include_empty_sessions(spark):
    late = [(BOTH[0], DAYS[2], None), (BOTH[1], DAYS[2], None)]
    out = audit(spark, [(s, t) for s in BOTH for t in DAYS[2:]], members=late)
    assert rows(out["member_count_anomalies"]) == [(d(DAYS[0]), 0, 2), (d(DAYS[1]), 0, 2)]
    assert out["summary"].first().anomalous_sessions == 2


def test_repeated_membership_counts_once(spark):
    spans = [(BOTH[0], DAYS[0], DAYS[3]), (BOTH[0], DAYS[2], None), (BOTH[1], DAYS[0], None)]
    out = audit(spark, [(s, t) for s in BOTH for t in DAYS], members=spans)
    assert out["summary"].first().expected_days == 10
    memberships = spark.createDataFrame(
        [(s, d(a), d(b) if b else None) for s, a, b in spans],
        "symbol string, valid_from date, valid_to date")
    assert rows(V.membership_overlap(memberships), "symbol", "valid_from") == [
        (BOTH[0], d(DAYS[2]))]


def test_closed_day_bars(spark):
    bars = bars_df(spark, [(BOTH[0], t, 1, 1, 1, 1, 1, 1) for t in ("2026-07-20", "2026-07-19",
                                                                  "2026-07-24")])
    days = spark.createDataFrame([(d(t),) for t in DAYS], "trade_date date")
    lives = spark.createDataFrame([(BOTH[0], d("2020-01-01"), d("2026-07-22"))],
                                  "symbol string, listed_on date, delisted_on date")
    assert rows(Q.closed_day_bars(bars, days, lives), "trade_date", "reason_code") == [
        (d("2026-07-19"), "CLOSED_DAY"), (d("2026-07-24"), "OUTSIDE_LIFECYCLE")]


def test_alignment_samples(spark):
    keys = lambda days: spark.createDataFrame(
        [("000001.SZ", d(t)) for t in days], "symbol string, trade_date date")
    out = Q.daily_factor_alignment(keys(DAYS[:3]), keys(DAYS[1:]))
    assert rows(out.fillna("-"), "class", "keys", "samples") == [
        ("daily_only", 1, "000001.SZ 2026-07-20"),
        ("factor_only", 2, "000001.SZ 2026-07-23;000001.SZ 2026-07-24"), ("matched", 2, "-")]
    assert out.where(F.col("class") == "matched").first().samples is None
