"""The quality gate on a stream of raw bars, with two sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..operators.quality import BAR_COLUMNS, bar_reason, with_units


def stream_quality(raw: DataFrame, requested: DataFrame, window_start, window_end) -> DataFrame:
    """Every raw bar with its ``reason_code``. Repeated keys are left to ``stream_dedup``."""
    asked = requested.select(F.col("symbol").alias("ts_code")).distinct().withColumn(
        "_requested", F.lit(True))
    joined = (raw.join(asked, "ts_code", "left")
              .withColumn("_in_window", X.between_dates("trade_date", window_start, window_end))
              .withColumn("_copies", F.lit(None).cast("bigint")))
    return (with_units(joined).withColumn("reason_code", bar_reason())
            .drop("_requested", "_copies", "_in_window"))


def two_sinks(folder: str):
    """Batch writer that splits judged bars into ``valid`` and ``quarantine``.

    Each batch owns its folders and replaces them, so a batch that runs again after a
    failure leaves the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in (
                ("valid", batch.where("reason_code is null").select(*BAR_COLUMNS)),
                ("quarantine", batch.where("reason_code is not null")
                 .select("symbol", "trade_date", "reason_code")),
            ):
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
