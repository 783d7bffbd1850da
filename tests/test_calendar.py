import pytest

from barloom.operators import calendars as C
from helpers import d, rows

SESSIONS = ["2026-07-27", "2026-07-28", "2026-07-29", "2026-07-30"]


def rate(spark, latest, expected, allowed=0):
    days = spark.createDataFrame([(d(t),) for t in SESSIONS], "trade_date date")
    table = spark.createDataFrame([("x", d(latest))], "name string, latest_date date")
    row = C.freshness(table, days, expected, allowed).first()
    return row.lag_sessions, row.passed, row.reason_codes


@pytest.mark.parametrize("latest,expected,allowed,lag,codes", [
    ("2026-07-30", "2026-07-30", 0, 0, []),
    ("2026-07-29", "2026-07-30", 1, 1, []),
    ("2026-07-28", "2026-07-30", 1, 2, ["DATA_STALE"]),
    ("2026-07-30", "2026-07-31", 0, 0, ["EXPECTED_AS_OF_NOT_TRADING_DAY"]),
    ("2026-07-30", "2026-07-29", 0, 0, ["LATEST_COMPLETE_IN_FUTURE"]),
    ("2026-07-26", "2026-07-28", 0, 2, ["LATEST_COMPLETE_NOT_TRADING_DAY", "DATA_STALE"]),
    ("2026-07-20", "2026-07-28", 9, 2, ["LATEST_COMPLETE_NOT_TRADING_DAY"]),
    ("2026-08-09", "2026-07-30", 0, 0, ["LATEST_COMPLETE_NOT_TRADING_DAY",
                                        "LATEST_COMPLETE_IN_FUTURE"]),
])
def test_freshness(spark, latest, expected, allowed, lag, codes):
    assert rate(spark, latest, expected, allowed) == (lag, not codes, codes)


def test_calendar_gaps_and_last_open(spark):
    rows_in = [("SSE", d(t), o) for t, o in (("2026-07-27", 1), ("2026-07-29", 1),
                                             ("2026-07-30", 0))]
    cal = spark.createDataFrame(rows_in, "exchange string, cal_date date, is_open int")
    assert rows(C.calendar_gaps(cal, "2026-07-27", "2026-07-29")) == [
        (d("2026-07-28"), "MISSING"), (d("2026-07-30"), "EXTRA")]
    assert C.as_of_is_last_open(cal, "2026-07-29").first().matches
    assert rows(C.open_sessions(cal)) == [(d("2026-07-27"),), (d("2026-07-29"),)]


def test_index_counts_from_zero(spark):
    days = spark.createDataFrame([(d(t),) for t in SESSIONS[::-1] + SESSIONS], "trade_date date")
    assert rows(C.calendar_index(days)) == [(d(t), i) for i, t in enumerate(SESSIONS)]


def test_stage_health(spark):
    rated = spark.createDataFrame([("a", ["DATA_STALE"]), ("b", []), ("c", ["DATA_STALE", "A"])],
                                  "name string, reason_codes array<string>")
    times, digest = ("2026-01-05T09:00:00Z", "2026-01-05T09:01:00+00:00"), "0" * 64
    row = C.stage_health(rated, "r", *times, digest).first()
    assert (row.status, row.reason_codes, row.finished_at) == (
        "fail", ["A", "DATA_STALE"], "2026-01-05T09:01:00Z")
    assert C.stage_health(rated.where("name = 'b'"), "r", *times, digest).first().status == "pass"
    for bad in (("", *times, digest), ("r", *times, "0"), ("r", *times[::-1], digest),
                ("r", times[0], "2026-01-05T09:01:00+08:00", digest)):
        with pytest.raises(ValueError):
            C.stage_health(rated, *bad)
