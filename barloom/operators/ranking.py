"""Cross-sections: daily ranks, top-k targets, rank correlations, recommendations.

A cross-section has one row per symbol, and the form of a symbol (six digits, three
exchanges) allows three million of them, so a per-date window is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .costs import market_rules_lookup
from .features import FEATURE_NAMES


def score_with(features: DataFrame, score) -> DataFrame:
    """Add ``score`` from a Column, a fitted pipeline or a function of the DataFrame.

    A Column (also a pandas UDF applied to columns) stays in one plan; a pipeline must
    produce a ``prediction`` column. Whatever comes back must hold the columns of ``features``
    with their types, and a numeric ``score``; nothing else may be added.
    """
    if isinstance(score, Column):
        scored = features.withColumn("score", score)
    elif hasattr(score, "transform"):
        made = score.transform(features)
        if "prediction" not in made.columns:
            raise ValueError("the fitted model gives no prediction column")
        scored = made.select(*features.columns, F.col("prediction").alias("score"))
    elif isinstance(score, Callable):
        scored = score(features)
    else:
        raise TypeError("score must be a Column, a fitted model or a function")
    return _checked(features, scored)


def _checked(features: DataFrame, scored: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in scored.schema}
    wanted = {f.name: f.dataType for f in features.schema if f.name != "score"}
    changed = sorted(n for n, t in wanted.items() if kinds.get(n) != t)
    added = sorted(kinds.keys() - wanted.keys() - {"score"})
    if changed or added or len(scored.columns) != len(kinds):
        raise ValueError(f"scoring changed or lost {changed} and added {added}")
    if not isinstance(kinds.get("score"), NumericType):
        raise ValueError("the score is missing or not a number")
    return scored.withColumn("score", F.col("score").cast("double"))


def daily_rank(scores: DataFrame) -> DataFrame:
    """Rank by score, best first, ties by symbol; strength falls from 1 towards 0."""
    day = Window.partitionBy("trade_date")
    rank = F.row_number().over(day.orderBy(F.desc("score"), "symbol"))
    return scores.select(
        "symbol", "trade_date", "score", rank.alias("rank"),
        F.count("*").over(day).alias("_n"),
    ).select("symbol", "trade_date", "score", "rank",
             F.round(1 - (F.col("rank") - 1) / F.col("_n"), 4).alias("rank_strength"))


def top_k_targets(scores: DataFrame, k: int, per_weight: float,
                  max_single_weight: float) -> DataFrame:
    """The k best symbols of every date, each with the same capped weight.

    Each task keeps its own k best per date before the shuffle.
    """
    order = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    return (scores.select("symbol", "trade_date", "score", F.row_number().over(order).alias("rank"))
            .where(F.col("rank") <= k)
            .withColumn("target_weight", F.lit(float(min(per_weight, max_single_weight)))))


def momentum_argmax(bars: DataFrame, universe: DataFrame | None = None,
                    target_weight: float = 1.0) -> DataFrame:
    """Per date, the eligible symbol with the largest one-day return; ties to the larger."""
    if universe is not None:
        bars = bars.join(universe.where("eligible").select("symbol"), "symbol", "left_semi")
    own = Window.partitionBy("symbol").orderBy("trade_date")
    moves = bars.select("symbol", "trade_date",
                        (F.col("close") / F.lag("close").over(own) - 1).alias("ret"))
    best = F.max(F.struct("ret", "symbol"))
    return (moves.where("ret is not null").groupBy("trade_date").agg(best.alias("b"))
            .select("trade_date", F.col("b.symbol").alias("symbol"), F.col("b.ret").alias("ret"),
                    F.lit(target_weight).alias("target_weight")))


def _ordinal_correlation() -> Column:
    """Correlation of two ordinal ranks of the same rows.

    Ordinal ranks of n rows are 0..n-1 in some order, so their mean and variance follow
    from n, and only the sum of products needs the data. The sums are exact decimals of 38
    digits, which hold the cubes of more rows than a table can have.
    """
    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    n = F.count("*")
    count = n.cast("double")
    products = F.sum(wide(F.col("_rx")) * wide(F.col("_ry"))).cast("decimal(38,0)")
    whole = (n.cast("decimal(12,0)") * (n - 1).cast("decimal(12,0)")
             * (n - 1).cast("decimal(12,0)")).cast("decimal(38,0)")
    centred = (products * 4 - whole).cast("double")
    return F.when(n > 1, 3 * centred / F.when(n > 1, count * (count - 1) * (count + 1))
                  ).otherwise(0.0)


def rank_ic_by_date(pairs: DataFrame, min_pairs: int = 3) -> DataFrame:
    """Rank correlation of ``score`` and ``label`` per date; ties go by symbol."""
    pairs = pairs.where("score is not null and label is not null")
    day = Window.partitionBy("trade_date")
    ranked = pairs.select(
        "trade_date",
        (F.row_number().over(day.orderBy("score", "symbol")) - 1).cast("bigint").alias("_rx"),
        (F.row_number().over(day.orderBy("label", "symbol")) - 1).cast("bigint").alias("_ry"))
    return (ranked.groupBy("trade_date")
            .agg(F.count("*").alias("pairs"), _ordinal_correlation().alias("ic"))
            .where(F.col("pairs") >= min_pairs))


def rank_ic(pairs: DataFrame, min_pairs: int = 3) -> DataFrame:
    """One row: the mean rank correlation over the dates and how many there were."""
    return rank_ic_by_date(pairs, min_pairs).agg(
        F.count("*").alias("dates"), F.avg("ic").alias("rank_ic"))


def feature_importance(scored: DataFrame, names: Sequence[str] = FEATURE_NAMES,
                       top: int = 3) -> DataFrame:
    """Features by absolute rank correlation with the score on the latest date."""
    latest = scored.agg(F.max("trade_date").alias("trade_date"))
    rows = scored.join(F.broadcast(latest), "trade_date", "left_semi")
    long = rows.unpivot(["symbol", "score"], list(names), "name", "value")
    each = Window.partitionBy("name")
    ranked = long.select(
        "name",
        (F.row_number().over(each.orderBy("value", "symbol")) - 1).cast("bigint").alias("_rx"),
        (F.row_number().over(each.orderBy("score", "symbol")) - 1).cast("bigint").alias("_ry"))
    return (ranked.groupBy("name")
            .agg(F.round(F.abs(_ordinal_correlation()), 6).alias("weight"))
            .orderBy(F.desc("weight"), "name").limit(top))


def recommend(ranks: DataFrame, positions: DataFrame, bars_latest: DataFrame, rules: DataFrame,
              signal_date, last_execution_day, top_k: int) -> DataFrame:
    """HOLD, BUY, SELL or WATCH for every ranked symbol, with a price band and notes.

    ``ranks`` is one cross-section, ``positions`` one portfolio (symbol, locked_shares),
    ``bars_latest`` the last two bars of each symbol at the signal date.
    """
    signal, execution = (F.lit(str(d)).cast("date") for d in (signal_date, last_execution_day))
    held = positions.select("symbol", "locked_shares", F.lit(True).alias("_held"))
    joined = market_rules_lookup(
        ranks.join(held, "symbol", "left").join(bars_latest, "symbol", "left"), rules)
    is_held, chosen = F.col("_held").isNotNull(), F.col("rank") <= top_k
    action = (F.when(chosen & is_held, "HOLD").when(chosen, "BUY")
              .when(is_held, "SELL").otherwise("WATCH"))
    close, before, near = F.col("last_close"), F.col("second_close"), F.col("price_limit_pct") * 0.95
    notes = F.array_compact(F.array(
        F.when(F.col("last_date") < signal, "NO_BAR_ON_SIGNAL_DATE"),
        F.when(is_held & (F.col("last_date") < execution), "VALUATION_FROZEN_NO_BAR"),
        F.when(close >= before * (1 + near), "NEAR_LIMIT_UP"),
        F.when(close <= before * (1 - near), "NEAR_LIMIT_DOWN"),
        F.when(F.col("locked_shares") > 0, "T1_LOCKED_SHARES")))
    buy = F.col("recommendation") == "BUY"
    return (joined.withColumn("recommendation", action).select(
        "symbol", "rank", F.round("score", 6).alias("score"), "recommendation", "rank_strength",
        F.when(buy, F.round(close * 0.98, 4)).alias("band_low"),
        F.when(buy, F.round(close, 4)).alias("band_high"), notes.alias("risk_notes")))
