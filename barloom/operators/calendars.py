"""Trading calendar: index, gaps, sessions, freshness and the part of the day.

A calendar has one row per day, a few thousand in all, so it may be ordered in one
task and broadcast; nothing else here is.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import session_label


def small(days: DataFrame, on: str = "trade_date") -> DataFrame:
    """Broadcast hint for a table of one row per day; a day with several different rows raises.

    That bounds its size whatever it is made from: a date column holds at most 3.7 million
    different days, and a market's history some tens of thousands.
    """
    rest = [c for c in days.columns if c != on]
    if not rest:
        return F.broadcast(days.distinct())
    row = F.struct(*rest)
    one = days.groupBy(on).agg(F.min(row).alias("_row"), F.max(row).alias("_other"))
    same = F.assert_true(F.col("_row") == F.col("_other"), f"a {on} has several different rows")
    checked = one.where(same.isNull())
    return F.broadcast(checked.select(*[F.col(f"_row.{c}").alias(c) if c != on else F.col(on)
                                        for c in days.columns]))


def sessions(bars: DataFrame) -> DataFrame:
    """Distinct dates that have any bar."""
    return bars.select("trade_date").distinct()


def open_sessions(calendar: DataFrame) -> DataFrame:
    return calendar.where("is_open = 1").select(F.col("cal_date").alias("trade_date")).distinct()


def calendar_index(days: DataFrame, on: str = "trade_date") -> DataFrame:
    """Dense position of every day, counted from 0."""
    order = Window.orderBy(on)
    return days.select(on).distinct().select(
        on, (F.row_number().over(order) - 1).cast("bigint").alias("idx"))


def calendar_gaps(calendar: DataFrame, window_start, window_end) -> DataFrame:
    """Days missing from, or outside, the full window."""
    full = calendar.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(str(window_start)).cast("date"), F.lit(str(window_end)).cast("date")))
        .alias("cal_date"))
    have = calendar.select("cal_date")
    return (full.exceptAll(have).select("cal_date", F.lit("MISSING").alias("kind"))
            .union(have.exceptAll(full).select("cal_date", F.lit("EXTRA").alias("kind"))))


def as_of_is_last_open(calendar: DataFrame, as_of) -> DataFrame:
    """One row: the last open day and whether it is the dataset's as-of date."""
    last = F.max(F.when(F.col("is_open") == 1, F.col("cal_date")))
    return calendar.agg(last.alias("last_open")).select(
        "last_open", (F.col("last_open") == F.lit(str(as_of)).cast("date")).alias("matches"))


def freshness(latest: DataFrame, calendar: DataFrame, expected_as_of,
              allowed_lag_sessions: int = 0) -> DataFrame:
    """Sessions each dataset lags behind the expected date, with reason codes.

    ``latest`` has ``name`` and ``latest_date``. The lag counts the sessions in
    ``(latest, expected]``: a difference of positions, not a join on ranges. Days that
    are no session take the position of the last session before them.
    """
    if allowed_lag_sessions < 0:
        raise ValueError("allowed lag cannot be negative")
    expected = F.lit(str(expected_as_of)).cast("date")
    index = calendar_index(calendar)
    # One row about the calendar: its first day and the sessions up to the expected date.
    edge = index.agg(
        F.min("trade_date").alias("first"), F.max("trade_date").alias("last"),
        F.count_if(F.col("trade_date") <= expected).alias("due"),
        F.count_if(F.col("trade_date") == expected).alias("is_session")).first()
    if edge.first is None:
        raise ValueError("the calendar has no session")
    days = calendar.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(edge.first), F.lit(edge.last))).alias("day"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    position = (days.join(index, F.col("day") == F.col("trade_date"), "left")
                .select(F.col("day").alias("latest_date"),
                        F.col("trade_date").isNotNull().alias("is_session"),
                        (F.max("idx").over(so_far) + 1).alias("_done")))
    joined = latest.join(small(position, "latest_date"), "latest_date", "left")
    # A date outside the calendar lies before every session, or after the last one.
    done = F.coalesce("_done", F.when(F.col("latest_date") < F.lit(edge.first), 0)
                      .otherwise(edge.due))
    out = joined.select(
        "name", "latest_date",
        F.greatest(F.lit(edge.due) - done, F.lit(0)).cast("bigint").alias("lag_sessions"),
        F.coalesce("is_session", F.lit(False)).alias("is_session"),
        F.lit(edge.is_session > 0).alias("expected_is_session"))
    codes = F.array_compact(F.array(
        F.when(~F.col("expected_is_session"), "EXPECTED_AS_OF_NOT_TRADING_DAY"),
        F.when(~F.col("is_session"), "LATEST_COMPLETE_NOT_TRADING_DAY"),
        F.when(F.col("latest_date") > expected, "LATEST_COMPLETE_IN_FUTURE"),
        F.when(F.col("lag_sessions") > allowed_lag_sessions, "DATA_STALE")))
    return out.select("name", "latest_date", "lag_sessions",
                      (F.size(codes) == 0).alias("passed"), codes.alias("reason_codes"))


def stage_health(rated: DataFrame, run_id: str, started_at: str, finished_at: str,
                 manifest_sha256: str) -> DataFrame:
    """One row: whether the data stage of a run passed, when it ran (UTC), on which manifest, and
    the distinct reason codes of all datasets in ``rated`` (the output of ``freshness``)."""
    if not run_id:
        raise ValueError("a run needs an id")
    if not re.fullmatch("[0-9a-f]{64}", manifest_sha256):
        raise ValueError("the manifest digest is 64 lower-case hex digits")
    times = [datetime.fromisoformat(t.replace("Z", "+00:00")) for t in (started_at, finished_at)]
    if any(t.utcoffset() != timedelta(0) for t in times):
        raise ValueError("times must be UTC")
    if times[1] < times[0]:
        raise ValueError("a run cannot finish before it starts")
    codes = rated.select(F.explode("reason_codes").alias("code")).agg(
        F.array_sort(F.collect_set("code")).alias("reason_codes"))  # a handful of codes
    return codes.select(
        F.lit(run_id).alias("run_id"), F.lit("data").alias("stage"),
        F.when(F.size("reason_codes") == 0, "pass").otherwise("fail").alias("status"),
        *[F.lit(t.strftime("%Y-%m-%dT%H:%M:%SZ")).alias(n) for t, n in
          zip(times, ("started_at", "finished_at"), strict=True)],
        F.lit(manifest_sha256).alias("dataset_manifest_sha256"), "reason_codes")


def label_sessions(events: DataFrame, open_days: DataFrame, utc_offset_hours: int = 8,
                   at: str = "ts") -> DataFrame:
    """Part of the trading day of each UTC timestamp. Works on streams."""
    local = F.col(at) + F.expr(f"interval {int(utc_offset_hours)} hours")
    days = small(open_days.select(F.col("trade_date").alias("_day"),
                                  F.lit(True).alias("_session")), "_day")
    placed = (events.withColumn("_local", local)
              .withColumn("_date", F.to_date("_local"))
              .join(days, F.col("_date") == F.col("_day"), "left"))
    label = session_label("_local", F.col("_session"))
    return (placed.withColumn("session_label", label)
            .withColumn("is_open", F.col("session_label") == "OPEN")
            .drop("_local", "_day", "_session").withColumnRenamed("_date", "calendar_date"))
