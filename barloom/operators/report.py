"""Report documents: one JSON document per account from aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positions import recent_actions


def report_document(positions: DataFrame, trades: DataFrame, cash: DataFrame,
                    state: DataFrame | None = None, last_actions: int = 20,
                    ledger: DataFrame | None = None, nav: DataFrame | None = None,
                    metrics: DataFrame | None = None) -> DataFrame:
    """One document per account: cash, totals, positions, last actions, performance and notices.

    ``positions`` is a position report (one row per held symbol), ``trades`` the executed
    trades with costs, ``state`` an optional signal state per account. ``ledger`` adds the average
    cost of each position, ``nav`` (account, trade_date, nav) the curve and ``metrics`` (series and
    its figures) the figures of the performance part. Lists are bounded by the universe, by
    ``last_actions`` and by the valuation days.
    """
    if ledger is not None:
        costs = ledger.select("account", "symbol", F.round("avg_cost", 4).alias("avg_cost"))
        positions = positions.join(costs, ["account", "symbol"], "left")
    else:
        positions = positions.withColumn("avg_cost", F.lit(None).cast("double"))
    held = positions.groupBy("account").agg(
        F.sum(F.col("market_value").cast("decimal(30,8)")).cast("decimal(36,8)")
        .alias("held_value"),
        F.array_sort(F.collect_list(F.struct("symbol", "shares", "locked_shares", "avg_cost", "last_price",
                                             F.round("market_value", 2).alias("market_value"),
                                             "weight"))).alias("positions"))
    actions = recent_actions(trades, last_actions).groupBy("account").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(
            "trade_date", "trade_id", "symbol", "side", "shares", "price", "gross",
            "total_cost")))).alias("recent_actions"))
    row = cash.join(held, "account", "left").join(actions, "account", "left")
    performance = []
    if nav is not None:
        curve = nav.groupBy("account").agg(F.array_sort(F.collect_list(
            F.struct("trade_date", "nav"))).alias("nav_curve"))
        row = row.join(curve, "account", "left")
        performance.append(F.coalesce("nav_curve", F.array()).alias("nav_curve"))
    if metrics is not None:
        row = row.join(metrics.select(F.col("series").alias("account"), F.struct(*[
            c for c in metrics.columns if c != "series"]).alias("metrics")), "account", "left")
        performance.append(F.col("metrics"))
    notices = F.array().cast("array<string>")
    if state is not None:
        row = row.join(state.select("account", "state"), "account", "left")
        notices = F.array_compact(F.array(F.when(
            F.col("state") != "ACTIVE", F.concat(F.lit("SIGNAL_STATE_"), "state"))))
    value = F.coalesce("held_value", F.lit(0)).cast("decimal(36,8)")
    total = F.round(F.col("cash").cast("decimal(36,8)") + value, 2)
    document = F.struct(
        F.col("account"),
        F.struct(F.col("cash"), F.round(value, 2).alias("market_value"),
                 total.alias("total_assets"),
                 F.coalesce("positions", F.array()).alias("positions"),
                 F.coalesce("recent_actions", F.array()).alias("recent_actions"))
        .alias("portfolio"),
        *([F.struct(*performance).alias("performance")] if performance else []),
        notices.alias("notices"))
    return row.select("account", F.to_json(document).alias("document"),
                      F.coalesce(F.size("positions"), F.lit(0)).alias("position_count"),
                      F.coalesce(F.size("recent_actions"), F.lit(0)).alias("action_count"))


def model_document(rankings: DataFrame, importances: DataFrame, checks: DataFrame,
                   splits: DataFrame, notices: list[str], part_rows: int = 1000) -> DataFrame:
    """Documents per signal date: rankings with factors, checks, splits and notices.

    A date's rankings are cut into parts of ``part_rows`` ranks, each a document of its own with
    its ``part`` (from 1) and the number of ``parts``, so no cell grows with the universe. The
    small pieces (three factors, six checks, one split) become one row each and are attached to
    the parts, not to the symbols.
    """
    factors = importances.agg(F.array_sort(F.collect_list(F.struct("name", "weight")))
                              .alias("factors"))
    listed = checks.agg(F.array_sort(F.collect_list(F.struct("check_id", "status")))
                        .alias("leak_checks"))
    part = (F.floor((F.col("rank") - 1) / part_rows) + 1).cast("int")
    by_part = rankings.groupBy("trade_date", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "symbol", "score", "rank_strength")))
        .alias("rankings"))
    row = by_part.withColumn("parts", F.max("part").over(Window.partitionBy("trade_date")))
    small_parts = splits.select(F.struct(*splits.columns).alias("splits"))
    for piece in (factors, listed, small_parts):
        row = row.join(F.broadcast(piece))  # one row
    body = F.struct("trade_date", "part", "parts", "rankings", "factors", "leak_checks", "splits",
                    F.array(*[F.lit(n) for n in notices]).cast("array<string>").alias("notices"))
    return row.select("trade_date", "part", "parts", F.size("rankings").alias("ranked"),
                      F.to_json(body).alias("document"))
