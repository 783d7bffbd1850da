"""Bars and deduplication on streams of ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, key: str = "symbol", at: str = "ts", width: str = "1 day",
                delay: str = "1 day") -> DataFrame:
    """Bars per key and tumbling window of event time; late ticks are dropped.

    In append mode a bar is emitted once the watermark has passed its window.
    """
    return (ticks.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
            .groupBy(F.window(at, width).alias("w"), key)
            .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
                 F.sum("volume").cast("double").alias("volume"),
                 F.sum("amount").cast("double").alias("amount"))
            .select(key, F.to_date("w.start").alias("trade_date"), "open", "high", "low",
                    "close", "volume", "amount"))


def closing_tick(ticks: DataFrame, at: str = "ts", width: str = "1 day",
                 delay: str = "1 day") -> DataFrame:
    """One row of nulls but for ``at``: a time that puts the watermark past the window of the last
    tick. ``ticks`` is the whole input as a batch.

    Its own window stays open, so a stream that ends with it emits every bar and none for it. It
    belongs in the last batch that has ticks: those of later batches would be late.
    """
    end = F.max(F.window(F.col(at).cast("timestamp"), width).getField("end"))
    last = ticks.agg(end.alias("end")).where(F.col("end").isNotNull()).select(
        (F.col("end") + F.expr(f"interval {delay}")).alias("closing"))
    return last.select(*[F.col("closing").cast(f.dataType).alias(f.name) if f.name == at
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in ticks.schema])


def stream_dedup(rows: DataFrame, keys: Sequence[str], at: str = "ts",
                 delay: str = "1 day") -> DataFrame:
    """First row per key; state is dropped once the watermark has passed it."""
    return (rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
            .dropDuplicatesWithinWatermark(list(keys)))
