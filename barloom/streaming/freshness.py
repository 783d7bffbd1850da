"""Freshness of each symbol on a stream of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calendars import freshness


def stream_freshness(bars: DataFrame) -> DataFrame:
    """Latest date per symbol as a running maximum; run it in update mode."""
    return bars.groupBy("symbol").agg(F.max("trade_date").alias("latest_date"))


def freshness_sink(folder: str, calendar: DataFrame, expected_as_of, allowed_lag: int = 0):
    """Batch writer that rates the symbols a batch moved against the calendar."""
    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.withColumnRenamed("symbol", "name")
        freshness(latest, calendar, expected_as_of, allowed_lag).write.mode(
            "overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def current_freshness(spark, folder: str) -> DataFrame:
    """The newest rating of every symbol over all batches."""
    rows = spark.read.parquet(folder)
    fields = [c for c in rows.columns if c not in ("name", "batch")]
    newest = F.max_by(F.struct(*fields), "batch")
    return rows.groupBy("name").agg(newest.alias("r")).select("name", "r.*")
