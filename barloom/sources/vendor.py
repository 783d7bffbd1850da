"""Vendor tables: text columns in, typed columns and a ``reason_code`` out.

A row with a null code is accepted. Repeated keys are found by a pre-aggregated count of
the rows that pass the other checks; all copies are marked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as X


def _mark_duplicates(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set DUPLICATE_KEY on rows whose key repeats among the rows without a code."""
    repeated = (judged.where("reason_code is null").groupBy(*keys)
                .agg(F.count("*").alias("_copies")).where("_copies > 1"))
    code = F.coalesce("reason_code", F.when(F.col("_copies").isNotNull(), "DUPLICATE_KEY"))
    return (judged.join(repeated, list(keys), "left").withColumn("reason_code", code)
            .drop("_copies").select(*judged.columns))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _outside(c: str, start, end) -> Column:
    return ~X.between_dates(c, start, end)


def parse_trade_cal(raw: DataFrame, exchange: str, window_start, window_end) -> DataFrame:
    typed = raw.select(
        "exchange", F.col("cal_date").alias("raw_date"), X.vendor_date("cal_date").alias("cal_date"),
        F.expr("try_cast(is_open as int)").alias("is_open"),
        F.col("pretrade_date").alias("raw_pretrade"),
        X.vendor_date("pretrade_date").alias("pretrade_date"))
    judged = typed.withColumn("reason_code", X.reason(
        (_blank("exchange"), "INVALID_EXCHANGE"),
        (F.col("exchange") != exchange, "EXCHANGE_MISMATCH"),
        (F.col("cal_date").isNull(), "INVALID_DATE"),
        (_outside("cal_date", window_start, window_end), "DATE_OUTSIDE_WINDOW"),
        (~F.coalesce(F.col("is_open").isin(0, 1), F.lit(False)), "INVALID_IS_OPEN"),
        (~_blank("raw_pretrade") & F.col("pretrade_date").isNull(), "INVALID_PRETRADE_DATE")))
    return _mark_duplicates(judged, ["exchange", "cal_date"]).drop("raw_pretrade")


def parse_securities(raw: DataFrame) -> DataFrame:
    """Master rows of the status batches; ``batch`` is the status that was asked for.

    Rows with an unusable vendor code are kept as evidence: fingerprint and safe code.
    """
    vendor = ["ts_code", "symbol", "name", "area", "industry", "market", "list_date",
              "delist_date", "list_status"]
    typed = raw.select(
        "batch", "ts_code", "symbol", "name",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("area", "industry", "market")],
        X.vendor_date("list_date").alias("list_date"),
        X.vendor_date("delist_date").alias("delist_date"), "list_status",
        F.col("list_date").alias("_list"), F.col("delist_date").alias("_delist"),
        X.row_fingerprint(vendor).alias("row_fingerprint"),
        X.safe_vendor_code("ts_code").alias("vendor_ts_code"))
    prefix = F.regexp_extract("ts_code", r"^(.*)\.[^.]*$", 1)
    dotted = F.col("ts_code").contains(".")
    judged = typed.withColumn("reason_code", X.reason(
        (_blank("symbol"), "EMPTY_SYMBOL"),
        (_blank("name"), "EMPTY_NAME"),
        (~_blank("_list") & F.col("list_date").isNull(), "INVALID_LIST_DATE"),
        (~_blank("_delist") & F.col("delist_date").isNull(), "INVALID_DELIST_DATE"),
        (~F.col("list_status").eqNullSafe(F.col("batch")), "STATUS_MISMATCH"),
        (F.col("delist_date") < F.col("list_date"), "DELIST_BEFORE_LIST"),
        (F.col("ts_code").isNull(), "INVALID_CODE_TYPE"),
        (dotted & (F.col("symbol") != prefix), "CODE_SYMBOL_MISMATCH")))
    marked = _mark_duplicates(judged, ["batch", "ts_code"])
    code = F.coalesce("reason_code", F.when(~X.valid_symbol("ts_code"), "INVALID_VENDOR_TS_CODE"))
    return marked.withColumn("reason_code", code).drop("_list", "_delist")


def split_securities(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted master rows, and rejection evidence without the row itself."""
    accepted = judged.where("reason_code is null").drop(
        "reason_code", "row_fingerprint", "vendor_ts_code", "batch")
    rejected = judged.where("reason_code is not null").select(
        F.col("batch").alias("list_status"), F.col("reason_code").alias("reason"),
        "row_fingerprint", "vendor_ts_code")
    return accepted, rejected


def _requested(rows: DataFrame, requested: DataFrame) -> DataFrame:
    asked = requested.select(F.col("symbol").alias("ts_code")).distinct().withColumn(
        "_requested", F.lit(True))
    return rows.join(asked, "ts_code", "left")


def _symbol_and_date(window_start, window_end) -> list[tuple[Column, str]]:
    return [
        (~X.valid_symbol("ts_code"), "INVALID_SYMBOL"),
        (F.col("_requested").isNull(), "SYMBOL_NOT_REQUESTED"),
        (F.col("trade_date").isNull(), "INVALID_DATE"),
        (_outside("trade_date", window_start, window_end), "DATE_OUTSIDE_WINDOW"),
    ]


def _number(c: str) -> Column:
    return F.expr(f"try_cast({c} as double)").alias(c)


def parse_daily(raw: DataFrame, requested: DataFrame, window_start, window_end) -> DataFrame:
    numbers = ("open", "high", "low", "close", "vol", "amount")
    typed = _requested(raw, requested).select(
        "ts_code", X.vendor_date("trade_date").alias("trade_date"),
        *[_number(c) for c in numbers], "_requested")
    rules = _symbol_and_date(window_start, window_end)
    rules += [(~X.finite(c), f"INVALID_{c.upper()}") for c in numbers]
    judged = typed.withColumn("reason_code", X.reason(*rules)).drop("_requested")
    return _mark_duplicates(judged, ["ts_code", "trade_date"])


def parse_suspensions(raw: DataFrame, requested: DataFrame, window_start,
                      window_end) -> DataFrame:
    typed = _requested(raw, requested).select(
        "ts_code", X.vendor_date("trade_date").alias("trade_date"), "suspend_timing",
        "suspend_type", "_requested")
    rules = _symbol_and_date(window_start, window_end) + [
        (~F.coalesce(F.col("suspend_type").isin("S", "R"), F.lit(False)), "INVALID_TYPE")]
    judged = typed.withColumn("reason_code", X.reason(*rules)).drop("_requested")
    return _mark_duplicates(judged, ["ts_code", "trade_date", "suspend_type"])


def parse_adj_factors(raw: DataFrame, requested: DataFrame, window_start,
                      window_end) -> DataFrame:
    typed = _requested(raw, requested).select(
        "ts_code", X.vendor_date("trade_date").alias("trade_date"), _number("adj_factor"),
        "_requested")
    rules = _symbol_and_date(window_start, window_end) + [
        (~X.positive("adj_factor"), "INVALID_FACTOR")]
    judged = typed.withColumn("reason_code", X.reason(*rules)).drop("_requested")
    return _mark_duplicates(judged, ["ts_code", "trade_date"])
