"""Readers of normalised bars with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BARS


class SchemaError(ValueError):
    """Raised when stored columns differ from the fixed schema."""


def _same_fields(found: T.StructType, wanted: T.StructType) -> None:
    have = {f.name: f.dataType for f in found}
    want = {f.name: f.dataType for f in wanted}
    if have != want:
        missing = sorted(want.keys() - have.keys())
        extra = sorted(have.keys() - want.keys())
        kinds = sorted(n for n in want.keys() & have.keys() if want[n] != have[n])
        raise SchemaError(f"missing={missing} extra={extra} other type={kinds}")


def scan_bars(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Bars from Parquet up to ``as_of``; the date filter reaches the scan.

    The stored schema must be the fixed one exactly. Only footers are read to check it.
    """
    stored = spark.read.parquet(path)
    _same_fields(stored.schema, BARS)
    return stored.select(*BARS.names).where(F.col("trade_date") <= F.lit(as_of).cast("date"))


def scan_json_bars(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Bars from JSON (one array per file, or one object per line).

    Any field outside the fixed schema, any missing or mistyped one fails the read.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name == "trade_date"
                                      else f.dataType) for f in BARS])
    seen = spark.read.option("multiLine", True).json(path)
    if set(seen.columns) != set(BARS.names):
        raise SchemaError(f"fields {sorted(seen.columns)} are not {sorted(BARS.names)}")
    rows = spark.read.schema(raw).option("multiLine", True).option("mode", "FAILFAST").json(path)
    whole = rows.select("symbol", F.to_date("trade_date", "yyyy-MM-dd").alias("trade_date"),
                        *BARS.names[2:])
    anyone_null = F.lit(False)
    for name in BARS.names:
        anyone_null = anyone_null | F.col(name).isNull()
    checked = whole.where(F.when(anyone_null, F.raise_error(F.lit("bar row lacks a field")))
                          .otherwise(F.lit(True)).cast("boolean"))
    return checked.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
