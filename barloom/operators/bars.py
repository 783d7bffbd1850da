"""Bars: building, cutting at a date, latest rows and dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily bars from ticks ordered by ``seq``; combines on the map side, so a hot
    symbol or day reaches the shuffle as one row per task."""
    return ticks.groupBy(*keys).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").cast("double").alias("volume"),
        F.sum("amount").cast("double").alias("amount"),
    )


def as_of(df: DataFrame, through: str | date, dataset_as_of: str | date | None = None,
          on: str = "trade_date") -> DataFrame:
    """Rows visible at ``through``. Apply before any window: a date filter is not pushed
    below one. Asking past the dataset's own as-of date is an error."""
    if dataset_as_of is not None and str(through) > str(dataset_as_of):
        raise ValueError("cannot read past the as-of date of the dataset")
    return df.where(F.col(on) <= F.lit(str(through)).cast("date"))


def eligible_bars(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of the eligible members of a universe."""
    members = universe.where("eligible").select("symbol")
    return bars.join(members, "symbol", "left_semi")


def latest_two(bars: DataFrame) -> DataFrame:
    """Last and second-last date and close of every symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    top = (bars.select("symbol", "trade_date", "close")
           .withColumn("n", F.row_number().over(newest)).where("n <= 2"))

    def pick(n: int, column: str):
        return F.max(F.when(F.col("n") == n, F.col(column)))

    return top.groupBy("symbol").agg(
        pick(1, "trade_date").alias("last_date"), pick(1, "close").alias("last_close"),
        pick(2, "trade_date").alias("second_date"), pick(2, "close").alias("second_close"))


def dataset_stats(bars: DataFrame) -> DataFrame:
    """Row count and date range per symbol."""
    return bars.groupBy("symbol").agg(
        F.count("*").alias("row_count"), F.min("trade_date").alias("min_date"),
        F.max("trade_date").alias("max_date"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def universe_members(bars: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Universe of a dataset: its symbols, all valid from the first date of the dataset."""
    first = bars.agg(F.min("trade_date").alias("valid_from"))
    codes = F.array(*[F.lit(r) for r in sorted(set(reasons))])
    return bars.select("symbol").distinct().join(F.broadcast(first)).select(
        "symbol", "valid_from", F.lit(None).cast("date").alias("valid_to"),
        F.lit(True).alias("eligible"), codes.alias("reason_codes"))
