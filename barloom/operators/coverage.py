"""Coverage audit: every expected member-day, classified exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ordered_scan, spread
from .calendars import small

FOREVER = "9999-12-31"


def _end(column: str):
    return F.coalesce(F.col(column), F.lit(FOREVER).cast("date"))


def member_days(memberships: DataFrame, lifecycles: DataFrame, open_days: DataFrame,
                window_start, window_end) -> DataFrame:
    """(symbol, session) inside a membership and the listed life; a day that lies in two
    memberships comes twice.

    The two closed intervals are intersected per membership and expanded to days; the
    sessions then filter by equality, so no range join is planned.
    """
    first, last = (F.lit(str(d)).cast("date") for d in (window_start, window_end))
    spans = (
        memberships.join(lifecycles, "symbol")
        .select("symbol", "delisted_on",
                F.greatest("valid_from", "listed_on", first).alias("a"),
                F.least(_end("valid_to"), _end("delisted_on"), last).alias("b"))
        .where("a <= b"))
    days = spread(spans, "symbol").select(
        "symbol", "delisted_on", F.explode(F.sequence("a", "b")).alias("trade_date"))
    return days.join(small(open_days.select("trade_date")), "trade_date", "left_semi")


def expected_member_days(memberships: DataFrame, lifecycles: DataFrame, open_days: DataFrame,
                         window_start, window_end) -> DataFrame:
    """Distinct expected member-days."""
    return (member_days(memberships, lifecycles, open_days, window_start, window_end)
            .groupBy("symbol", "trade_date").agg(F.max("delisted_on").alias("delisted_on")))


def coverage_classify(expected: DataFrame, bars: DataFrame, suspensions: DataFrame) -> DataFrame:
    """BAR, else SUSPENDED (type S only), else EXPECTED_DELISTED, else MISSING.

    Expected days and both kinds of evidence are unioned and grouped by key: one
    aggregation finds the best evidence and drops repeated days, with no join.
    """
    nothing = F.lit(None).cast("date")
    rows = (
        expected.select("symbol", "trade_date", "delisted_on", F.lit(True).alias("_wanted"),
                        F.lit(0).alias("_e"))
        .union(bars.select("symbol", "trade_date", nothing, F.lit(False), F.lit(2)))
        .union(suspensions.where("suspend_type = 'S'")
               .select(F.col("ts_code"), "trade_date", nothing, F.lit(False), F.lit(1))))
    best = rows.groupBy("symbol", "trade_date").agg(
        F.max("delisted_on").alias("delisted_on"), F.max("_wanted").alias("_wanted"),
        F.max("_e").alias("_e")).where("_wanted")
    return best.select(
        "symbol", "trade_date", "delisted_on",
        F.when(F.col("_e") == 2, "BAR").when(F.col("_e") == 1, "SUSPENDED")
        .when(F.col("delisted_on") == F.col("trade_date"), "EXPECTED_DELISTED")
        .otherwise("MISSING").alias("class"))


def member_count_anomalies(expected: DataFrame, open_days: DataFrame, expected_members: int,
                           window_start, window_end) -> DataFrame:
    """Sessions whose active member count is not the expected one, zero included."""
    counts = expected.groupBy("trade_date").agg(F.count("*").alias("n"))
    first, last = (F.lit(str(d)).cast("date") for d in (window_start, window_end))
    return (open_days.where(F.col("trade_date").between(first, last))
            .join(counts, "trade_date", "left")
            .select("trade_date", F.coalesce("n", F.lit(0)).alias("actual_count"),
                    F.lit(expected_members).cast("bigint").alias("expected_count"))
            .where("actual_count <> expected_count"))


def per_symbol(classified: DataFrame) -> DataFrame:
    """Counts of each class per symbol; the first step of the audit summaries."""
    def n(name: str):
        return F.count_if(F.col("class") == name)

    return classified.groupBy("symbol").agg(
        F.count("*").alias("expected"), n("BAR").alias("bar"), n("SUSPENDED").alias("suspended"),
        n("EXPECTED_DELISTED").alias("delisted"), n("MISSING").alias("missing"),
        F.max("delisted_on").alias("delisted_on"))


def silent_skips(classified: DataFrame) -> DataFrame:
    """Symbols expected at least once and never observed in any way."""
    return per_symbol(classified).where("expected = missing").select("symbol", "expected")


def delisted_in_scope(classified: DataFrame, window_end) -> DataFrame:
    return (classified.groupBy("symbol").agg(F.max("delisted_on").alias("delisted_on"))
            .where(F.col("delisted_on") <= F.lit(str(window_end)).cast("date")))


def coverage_summary(classified: DataFrame, open_days: DataFrame, expected_members: int,
                     window_start, window_end) -> DataFrame:
    """One row: the counts of the audit, whether it passed, and why not.

    The classified days are derived once and grouped by symbol and by session together; both
    groupings combine on the map side, and end in one row. They lie on open days of the window.
    """
    first, last = (F.lit(str(d)).cast("date") for d in (window_start, window_end))
    names = {"bar": "BAR", "suspended": "SUSPENDED", "delisted": "EXPECTED_DELISTED",
             "missing": "MISSING"}
    both = classified.groupingSets([["symbol"], ["trade_date"]], "symbol", "trade_date").agg(
        F.grouping("symbol").alias("_session"), F.count("*").alias("expected"),
        *[F.count_if(F.col("class") == c).alias(n) for n, c in names.items()])
    of_symbol = F.col("_session") == 0
    calendar = F.broadcast(open_days.where(F.col("trade_date").between(first, last)).select(
        "trade_date").distinct().agg(F.count("*").alias("sessions")))  # one row
    row = both.agg(
        *[F.coalesce(F.sum(F.when(of_symbol, F.col(c))), F.lit(0)).alias(f"{c}_days")
          for c in ("expected", *names)],
        F.count_if(of_symbol & (F.col("expected") == F.col("missing"))).alias("silent_symbols"),
        F.count_if(~of_symbol).alias("_any"), F.count_if(
            ~of_symbol & (F.col("expected") == expected_members)).alias("_full"))
    row = row.join(calendar)
    regular = F.col("sessions") - F.col("_any") if expected_members == 0 else F.col("_full")
    row = row.withColumn("anomalous_sessions", F.col("sessions") - regular).drop("_any", "_full")
    codes = F.array_compact(F.array(
        F.when(F.col("missing_days") > 0, "MISSING_MEMBER_DAYS"),
        F.when(F.col("silent_symbols") > 0, "SILENT_MEMBER_SKIP"),
        F.when(F.col("anomalous_sessions") > 0, "MEMBER_COUNT_ANOMALY")))
    return row.withColumn("reason_codes", codes).withColumn("passed", F.size("reason_codes") == 0)


def audit_coverage(memberships: DataFrame, lifecycles: DataFrame, open_days: DataFrame,
                   bars: DataFrame, suspensions: DataFrame, window_start, window_end,
                   expected_members: int) -> dict[str, DataFrame]:
    """The whole audit as tables: classified days, anomalies, skips, delistings, summary."""
    wanted = member_days(memberships, lifecycles, open_days, window_start, window_end)
    expected = expected_member_days(memberships, lifecycles, open_days, window_start, window_end)
    classified = coverage_classify(wanted, bars, suspensions)
    anomalies = member_count_anomalies(expected, open_days, expected_members, window_start,
                                       window_end)
    return {
        "classified": classified,
        "member_count_anomalies": anomalies,
        "silent_skips": silent_skips(classified),
        "delisted_in_scope": delisted_in_scope(classified, window_end),
        "summary": coverage_summary(classified, open_days, expected_members, window_start,
                                    window_end),
    }


def class_reconciliation(classified: DataFrame) -> DataFrame:
    """Audit of the audit, per symbol: the classes add up and no day has two of them."""
    classes = ("BAR", "SUSPENDED", "EXPECTED_DELISTED", "MISSING")
    days = classified.groupBy("symbol", "trade_date").agg(
        F.count("*").alias("rows"), F.count_if(F.col("class").isin(*classes)).alias("known"),
        *[F.count_if(F.col("class") == c).alias(c) for c in classes])
    kinds = sum(((F.col(c) > 0).cast("int") for c in classes), F.lit(0))
    return days.groupBy("symbol").agg(
        F.sum("rows").alias("expected"), F.count("*").alias("distinct_days"),
        F.count_if(kinds > 1).alias("clashing_days"), F.sum("known").alias("classified"),
    ).withColumn("reconciles", (F.col("expected") == F.col("classified"))
                 & (F.col("expected") == F.col("distinct_days")) & (F.col("clashing_days") == 0))


def membership_overlap(memberships: DataFrame) -> DataFrame:
    """Intervals that intersect an earlier one of the same symbol.

    A running maximum of the ends so far, instead of a self-join on ranges.
    """
    ends = memberships.withColumn("_end", _end("valid_to"))
    year = F.year("valid_from")
    reach = ordered_scan(ends, ["symbol"], ["valid_from", "_end"],
                         running={"_reach": ("max", "_end")}, slice_by=year)
    before = ordered_scan(reach, ["symbol"], ["valid_from", "_end"],
                          previous={"_reach_before": "_reach"}, slice_by=year)
    return (before.where(F.col("valid_from") <= F.col("_reach_before"))
            .select("symbol", "valid_from", "valid_to",
                    F.col("_reach_before").alias("overlaps_until")))


def evidence_keys(bars: DataFrame, suspensions: DataFrame, window_start, window_end) -> DataFrame:
    """Distinct keys of both kinds of evidence, and whether each lies in the window."""
    first, last = (F.lit(str(d)).cast("date") for d in (window_start, window_end))
    return (bars.select("symbol", "trade_date")
            .union(suspensions.select(F.col("ts_code").alias("symbol"), "trade_date"))
            .distinct()
            .withColumn("in_window", F.col("trade_date").between(first, last)))


def suspension_evidence(wanted: DataFrame, suspensions: DataFrame, open_days: DataFrame,
                        lifecycles: DataFrame) -> DataFrame:
    """Symbols that should show a suspended session inside their life and show none."""
    shown = (suspensions.where("suspend_type = 'S'")
             .join(small(open_days.select("trade_date")), "trade_date", "left_semi")
             .select(F.col("ts_code").alias("symbol"), "trade_date")
             .join(lifecycles, "symbol")
             .where((F.col("trade_date") >= F.col("listed_on"))
                    & (F.col("trade_date") <= _end("delisted_on")))
             .select("symbol").distinct())
    return wanted.select("symbol").distinct().join(shown, "symbol", "left_anti")
