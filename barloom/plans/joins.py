"""Join helpers that keep one plan at every size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Lay a small table over all shuffle partitions before it is expanded.

    A few rows per symbol fit one file and so one task; exploding them to days there would
    leave the whole result to that task. The number is explicit because adaptive execution
    would merge partitions that are small before the expansion.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns)


def intervals_at(facts: DataFrame, intervals: DataFrame, key: str, at: str, start: str,
                 end: str, name: str) -> DataFrame:
    """``facts`` with ``name``: an array of the closed intervals of ``key`` that hold date ``at``.

    ``end`` may be null (open); an interval that ends before it starts holds no date. The distinct
    (key, month) pairs of the facts, a few per month whatever their number, gather the intervals
    that touch the month; the facts join these arrays by equality on key and month, which spreads a
    hot key over the calendar. No fact is repeated or grouped, so equal facts stay apart.
    """
    month = F.trunc(F.col(at), "month")
    until = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    months = facts.select(F.col(key).alias("_key"), month.alias("_month")).distinct()
    touching = intervals.where(F.col(start) <= until)
    touching = months.join(
        touching, (F.col("_key") == F.col(key)) & (F.trunc(F.col(start), "month") <= F.col("_month"))
        & (until >= F.col("_month")))
    one = F.struct(*[F.col(c) for c in intervals.columns if c != key])
    lists = touching.groupBy("_key", "_month").agg(F.collect_list(one).alias("_all"))
    joined = facts.join(lists, (F.col(key) == F.col("_key")) & (month == F.col("_month")), "left")
    hits = F.filter("_all", lambda s: (F.col(at) >= s[start]) & (
        s[end].isNull() | (F.col(at) <= s[end])))
    return joined.withColumn(name, F.coalesce(hits, F.filter("_all", lambda s: F.lit(False)))).drop(
        "_key", "_month", "_all")
