"""Queries run as streams to the end of their input, compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as Z
from ..operators.features import FEATURE_NAMES
from ..session import fresh_path
from ..streaming.freshness import current_freshness, freshness_sink
from ..streaming.quality import two_sinks
from . import fixtures as T
from .ctes import CTES, symbol
from .panel_queries import FEATURES_ROUNDED
from .quality_queries import JUDGED, W
from .registry import ORACLES, query

PARTS = ("1997-01-01", "1999-01-01")  # first days of the second and third part of a stream


def _ticks(lines):
    return lines.select(
        T.symbol_of(F.col("l_suppkey")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
        .alias("seq"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


def _stored_stream(spark, session, df, label):
    folder = fresh_path(spark, label)
    df.write.parquet(folder)
    return Z.stream_table(session, folder, "*.parquet")


@query("stream_bars", """
select * from bars""")
def stream_bars(spark, sf):
    session = Z.streaming_session(spark, Z.state_partitions(T.table(spark, sf, "lineitem")))
    ticks = _ticks(Z.stream_table(session, sf, "lineitem.parquet"))
    closing = _stored_stream(
        spark, session, Z.closing_tick(_ticks(T.table(session, sf, "lineitem"))), "closing-tick")
    bars = Z.stream_bars(ticks.union(closing), width="1 day", delay="1 day")
    return spark.read.parquet(Z.run_available(bars, "stream-bars"))


LATE_BARS = CTES["kbars"].replace("from lineitem", f"""from lineitem
  where not (l_orderkey % 7 = 0 and cast(l_shipdate as date) < date '{PARTS[0]}')""")


@query("stream_bars_late", f"""
select {symbol('k')} as symbol, trade_date, open, high, low, close, volume, amount
from ({LATE_BARS})""")
def stream_bars_late(spark, sf):
    """Ticks arrive in parts by date, in runs of one stream that stops and goes on; every seventh
    order of the first part comes with the third, when its bars are out, and is dropped."""
    session = Z.streaming_session(spark, Z.state_partitions(T.table(spark, sf, "lineitem")))
    ticks = T.table(session, sf, "lineitem")
    day, first = F.col("l_shipdate").cast("date"), F.lit(PARTS[0]).cast("date")
    late = (F.col("l_orderkey") % 7 == 0) & (day < first)
    part = F.when(late | (day >= F.lit(PARTS[1]).cast("date")), 2).when(day >= first, 1).otherwise(0)
    folder, state, output = (fresh_path(spark, n) for n in ("late-in", "late-state", "late-out"))
    for i in range(len(PARTS) + 1):
        ready = _ticks(ticks.where(part == i))
        if i == len(PARTS):
            ready = ready.union(Z.closing_tick(_ticks(ticks)))
        ready.write.mode("append").parquet(folder)
        bars = Z.stream_bars(Z.stream_table(session, folder, "*.parquet"), width="1 day",
                             delay="1 day")
        Z.run_available(bars, "late", checkpoint=state, output=output)
    return spark.read.parquet(output)


@query("stream_dedup", """
select distinct user_id, event_type, cast(ts as date) as day from events""")
def stream_dedup(spark, sf):
    session = Z.streaming_session(spark)
    events = Z.stream_table(session, sf, "events.parquet").select(
        "user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp"))
    first = Z.stream_dedup(events, ["user_id", "event_type", "day"])
    return spark.read.parquet(Z.run_available(first, "stream-dedup")).drop("ts")


@query("stream_quality", "select symbol, trade_date, reason_code from (" + JUDGED.replace(
    "  when copies > 1 then 'DUPLICATE_DAILY_BAR'\n", "") + ")")
def stream_quality(spark, sf):
    session = Z.streaming_session(spark)
    raw = _stored_stream(spark, session, T.raw_bars(spark, sf), "raw-bars")
    judged = Z.stream_quality(raw, T.requested(session, sf), *W)
    folder = fresh_path(spark, "stream-quality")
    Z.run_available(judged, "stream-quality", each_batch=two_sinks(folder))
    valid = spark.read.parquet(f"{folder}/valid").select(
        "symbol", "trade_date", F.lit(None).cast("string").alias("reason_code"))
    return valid.union(spark.read.parquet(f"{folder}/quarantine").select(
        "symbol", "trade_date", "reason_code"))


@query("stream_features", f"select symbol, trade_date, false as late, {FEATURES_ROUNDED} "
       "from features")
def stream_features(spark, sf):
    session = Z.streaming_session(spark)
    bars = _stored_stream(spark, session, T.bars(spark, sf), "bars")
    out = spark.read.parquet(Z.run_available(Z.stream_features(bars), "stream-features"))
    return out.select("symbol", "trade_date", "late",
                      *[F.round(n, 6).alias(n) for n in FEATURE_NAMES])


@query("stream_freshness")
def stream_freshness(spark, sf):
    session = Z.streaming_session(spark)
    bars = _stored_stream(spark, session, T.bars(spark, sf).select("symbol", "trade_date"),
                          "bar-keys")
    folder = fresh_path(spark, "stream-freshness")
    sink = freshness_sink(folder, T.open_days(session, sf), T.EXPECTED_AS_OF, 1)
    Z.run_available(Z.stream_freshness(bars), "stream-freshness", "update", each_batch=sink)
    rated = current_freshness(spark, folder)
    return rated.withColumn("reason_codes", F.array_join("reason_codes", ","))


ORACLES["stream_freshness"] = ORACLES["freshness"]
