"""Quality gate of raw daily bars and the audits around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from .bars import duplicate_keys

BAR_COLUMNS = ("symbol", "trade_date", "open", "high", "low", "close", "volume", "amount")


class QualityError(ValueError):
    """Raised by ``mode="failfast"`` when any row is rejected."""


def bar_reason(check_request: bool = True):
    """First failing code of a raw bar; needs ``_requested``, ``_in_window``, ``_copies``."""
    rules = [(F.col("trade_date").isNull(), "INVALID_TRADE_DATE")]
    if check_request:
        rules += [
            (F.col("_requested").isNull(), "REQUEST_SYMBOL_MISMATCH"),
            (~F.col("_in_window"), "REQUEST_DATE_MISMATCH"),
            (F.col("_copies").isNotNull(), "DUPLICATE_DAILY_BAR"),
        ]
    for price in ("open", "high", "low", "close"):
        rules += [(~X.finite(price), "NON_FINITE_VALUE"), (F.col(price) <= 0, "NON_POSITIVE_VALUE")]
    for size in ("vol", "raw_amount"):
        rules += [(~X.finite(size), "NON_FINITE_VALUE"), (F.col(size) < 0, "NEGATIVE_VALUE")]
    turnover = X.vwap_code("low", "high", "volume", "amount")
    return X.reason(
        *rules,
        (~X.finite("volume") | ~X.finite("amount"), "UNIT_CONVERSION_OVERFLOW"),
        (~X.valid_symbol("symbol"), "INVALID_SYMBOL"),
        ((F.col("volume") == 0) != (F.col("amount") == 0), "INCONSISTENT_ZERO_TURNOVER"),
        (~X.ohlc_ok("open", "high", "low", "close"), "INVALID_OHLC"),
        (turnover.isNotNull(), turnover),
    )


def with_units(raw: DataFrame) -> DataFrame:
    """Vendor columns under our names, with volume in shares and amount in CNY."""
    return raw.select(
        F.col("ts_code").alias("symbol"), "trade_date", "open", "high", "low", "close", "vol",
        F.col("amount").alias("raw_amount"), X.shares_from_lots("vol").alias("volume"),
        X.amount_from_thousands("amount").alias("amount"),
        *[c for c in raw.columns if c.startswith("_")])


def judge_bars(raw: DataFrame, requested: DataFrame, window_start, window_end) -> DataFrame:
    """Every raw bar with converted units and its ``reason_code`` (null when valid).

    Copies of a key are found by a pre-aggregated count. Only the keys that repeat are
    joined back, so a key with a huge number of copies is never gathered.
    """
    asked = requested.select(F.col("symbol").alias("ts_code")).distinct().withColumn(
        "_requested", F.lit(True))
    repeated = duplicate_keys(
        raw.where(X.between_dates("trade_date", window_start, window_end)),
        ["ts_code", "trade_date"]).withColumnRenamed("copies", "_copies")
    joined = (raw.join(asked, "ts_code", "left")
              .join(repeated, ["ts_code", "trade_date"], "left")
              .withColumn("_in_window",
                          X.between_dates("trade_date", window_start, window_end)))
    return (with_units(joined).withColumn("reason_code", bar_reason())
            .drop("_requested", "_copies", "_in_window"))


def normalize_bars(raw: DataFrame, requested: DataFrame, window_start, window_end,
                   mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Valid bars and quarantine. ``failfast`` raises if anything would be quarantined."""
    if str(window_end) < str(window_start):
        raise ValueError("window end precedes window start")
    if mode not in ("quarantine", "failfast"):
        raise ValueError(f"unknown mode {mode}")
    judged = judge_bars(raw, requested, window_start, window_end)
    valid = judged.where("reason_code is null").select(*BAR_COLUMNS)
    rejected = judged.where("reason_code is not null").select(
        "symbol", "trade_date", "reason_code",
        *[X.nonfinite_marker(c).alias(f"{c}_marker")
          for c in ("open", "high", "low", "close", "vol", "raw_amount")])
    if mode == "failfast":
        first = rejected.select("symbol", "trade_date", "reason_code").take(1)
        if first:
            raise QualityError(f"{first[0].reason_code} [{first[0].symbol} {first[0].trade_date}]")
    return valid, rejected


def ohlc_check(bars: DataFrame) -> DataFrame:
    """Bars whose prices contradict each other."""
    return bars.where(~X.ohlc_ok("open", "high", "low", "close")).select(
        "symbol", "trade_date", "open", "high", "low", "close")


def implied_vwap_check(bars: DataFrame) -> DataFrame:
    """Bars whose amount/volume contradicts the prices, with the code."""
    return (bars.withColumn("reason_code", X.vwap_code("low", "high", "volume", "amount"))
            .where("reason_code is not null").select("symbol", "trade_date", "reason_code"))


def closed_day_bars(bars: DataFrame, open_days: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Bars on closed days or outside the listed life of their security."""
    opened = open_days.select("trade_date").distinct().withColumn("_open", F.lit(True))
    judged = (bars.select("symbol", "trade_date")
              .join(opened, "trade_date", "left").join(lifecycles, "symbol", "left"))
    code = X.reason(
        (F.col("_open").isNull(), "CLOSED_DAY"),
        (F.col("listed_on").isNull(), "NO_LIST_DATE"),
        ((F.col("trade_date") < F.col("listed_on"))
         | F.coalesce(F.col("trade_date") > F.col("delisted_on"), F.lit(False)),
         "OUTSIDE_LIFECYCLE"))
    return (judged.withColumn("reason_code", code).where("reason_code is not null")
            .select("symbol", "trade_date", "reason_code"))


def unknown_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on the left with no match on the right."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def daily_factor_alignment(bars: DataFrame, factors: DataFrame, samples: int = 20) -> DataFrame:
    """How the keys of bars and adjustment factors match, with the first unmatched keys.

    One row per class. The samples are a top-k, which each task cuts before the shuffle.
    """
    keys = ["symbol", "trade_date"]
    sides = (bars.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("f"))
             .union(factors.select(*keys, F.lit(0), F.lit(1)))
             .groupBy(*keys).agg(F.max("b").alias("b"), F.max("f").alias("f")))
    classed = sides.select(*keys, F.when(F.col("b") + F.col("f") == 2, "matched")
                           .when(F.col("b") == 1, "daily_only").otherwise("factor_only")
                           .alias("class"))
    counts = classed.groupBy("class").agg(F.count("*").alias("keys"))
    shown = F.concat_ws(" ", "symbol", F.col("trade_date").cast("string"))
    tops = [classed.where(F.col("class") == name).orderBy("symbol", "trade_date").limit(samples)
            .select("class", shown.alias("key")) for name in ("daily_only", "factor_only")]
    listed = (tops[0].union(tops[1]).groupBy("class")
              .agg(F.array_join(F.array_sort(F.collect_list("key")), ";").alias("samples")))
    return counts.join(listed, "class", "left")


def dataset_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Counts of added and removed keys and of changed values per field."""
    a = old.select(*keys, F.struct(*fields).alias("o"))
    b = new.select(*keys, F.struct(*fields).alias("n"))
    both = a.join(b, keys, "full")
    present = F.col("o").isNotNull() & F.col("n").isNotNull()
    return both.agg(
        F.count_if(F.col("o").isNull()).alias("new_only"),
        F.count_if(F.col("n").isNull()).alias("old_only"),
        F.count_if(present).alias("in_both"),
        *[F.count_if(present & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(f"{c}_changed")
          for c in fields])
