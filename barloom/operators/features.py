"""Point-in-time features and forward labels over each symbol's own rows.

All windows share one partitioning and one order, so a panel costs one shuffle and one
sort. A symbol has at most one row per session (the key of a bar), which bounds every
window group by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import as_of as cut
from .calendars import small

# Feature names, minimum history, label horizons.
FEATURE_NAMES = (
    "ret_1d", "ret_5d", "ret_10d", "ret_20d", "vol_ratio_5d", "vol_ratio_20d", "amount_z_20d",
    "close_to_high_20d", "range_position_20d",
)
MIN_OBSERVATIONS = 21
DEFAULT_HORIZONS = (1, 3, 5)

def _history():
    return Window.partitionBy("symbol").orderBy("trade_date")


def _windows() -> dict[str, Column]:
    """Every window value the features need, once each: a repeated window expression is
    evaluated again for every use."""
    own = _history()
    last_5, last_20 = own.rowsBetween(-4, 0), own.rowsBetween(-19, 0)
    return {
        **{f"_close_{n}": F.lag("close", n).over(own) for n in (1, 5, 10, 20)},
        "_volume_5": F.avg("volume").over(last_5),
        "_volume_20": F.avg("volume").over(last_20),
        "_amount_mean": F.avg("amount").over(last_20),
        "_amount_std": F.stddev_pop("amount").over(last_20),
        "_high": F.max("high").over(last_20),
        "_low": F.min("low").over(last_20),
        "_seen": F.row_number().over(own),
    }


def _features() -> dict[str, Column]:
    """The features from the window values."""
    c = F.col
    span = c("_high") - c("_low")
    ratio = {n: F.when(c(f"_volume_{n}") > 0, c("volume") / c(f"_volume_{n}")).otherwise(1.0)
             for n in (5, 20)}
    return {
        **{f"ret_{n}d": c("close") / c(f"_close_{n}") - 1 for n in (1, 5, 10, 20)},
        "vol_ratio_5d": ratio[5],
        "vol_ratio_20d": ratio[20],
        "amount_z_20d": F.when(c("_amount_std") > 0, (c("amount") - c("_amount_mean"))
                               / c("_amount_std")).otherwise(0.0),
        "close_to_high_20d": c("close") / c("_high"),
        "range_position_20d": F.when(c("_high") > c("_low"), (c("close") - c("_low")) / span)
        .otherwise(0.5),
    }


def with_windows(bars: DataFrame, **more: Column) -> DataFrame:
    """Bars with the window values, and any further columns over the same windows."""
    return bars.select("*", *[w.alias(n) for n, w in {**_windows(), **more}.items()])


def features_of(windowed: DataFrame, *more: str, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Features of rows that carry the window values; unused windows are pruned."""
    every = _features()
    return windowed.select("symbol", "trade_date", *[every[n].alias(n) for n in names], *more)


def with_columns(bars: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chosen features on every bar; null returns where history is too short."""
    return features_of(with_windows(bars), names=names)


def feature_panel(bars: DataFrame, as_of=None, dataset_as_of=None) -> DataFrame:
    """The nine features for every bar with a full history behind it."""
    if as_of is not None:
        bars = cut(bars, as_of, dataset_as_of)
    return features_of(with_windows(bars).where(F.col("_seen") >= MIN_OBSERVATIONS))


def feature_replay(bars: DataFrame, as_of=None, dataset_as_of=None) -> DataFrame:
    """One-day return and volume against the mean of up to five rows, 12 decimals."""
    if as_of is not None:
        bars = cut(bars, as_of, dataset_as_of)
    own = _history()
    rows = bars.select("symbol", "trade_date", "close", "volume",
                       F.lag("close").over(own).alias("_before"),
                       F.avg("volume").over(own.rowsBetween(-4, 0)).alias("_mean"))
    return rows.select(
        "symbol", "trade_date",
        F.round(F.col("close") / F.col("_before") - 1, 12).alias("close_return_1d"),
        F.round(F.when(F.col("_mean") != 0, F.col("volume") / F.col("_mean")), 12)
        .alias("volume_ratio_5d"))


def forward_labels(bars: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS) -> DataFrame:
    """Return to the h-th next bar of the same symbol and the date it ends, per horizon."""
    if any(h < 1 for h in horizons):
        raise ValueError("label horizon must be positive")
    return bars.select("symbol", "trade_date",
                       *[c.alias(n) for n, c in label_columns(horizons).items()])


def label_columns(horizons: Sequence[int]) -> dict[str, Column]:
    own, columns = _history(), {}
    for h in horizons:
        columns[f"label_{h}"] = F.lead("close", h).over(own) / F.col("close") - 1
        columns[f"label_end_{h}"] = F.lead("trade_date", h).over(own)
    return columns


def safe_labels(bars: DataFrame, index: DataFrame, cutoff: Column | str,
                horizons: Sequence[int] = DEFAULT_HORIZONS) -> DataFrame:
    """Labels usable for a model cut at ``cutoff``; the others are null.

    Two clocks must both be inside: the calendar position of the row plus the horizon,
    and the symbol's own label end, which is later when the symbol skipped sessions.
    ``index`` is the calendar index; only the rows up to the cutoff are kept.
    """
    if isinstance(cutoff, str):
        cutoff = F.lit(cutoff).cast("date")
    labels = forward_labels(bars, horizons).where(F.col("trade_date") <= cutoff)
    return mask_labels(labels, index, cutoff, horizons)


def mask_labels(labels: DataFrame, index: DataFrame, cutoff: Column,
                horizons: Sequence[int]) -> DataFrame:
    """Null every label that either clock puts past the cutoff; other columns stay."""
    end = F.max(F.when(F.col("trade_date") == cutoff, F.col("idx"))).over(
        Window.partitionBy(F.lit(0)))
    clock = index.select("trade_date", (end - F.col("idx")).alias("_room"))
    joined = labels.join(small(clock), "trade_date")
    masked = {}
    for h in horizons:
        usable = (F.col("_room") >= h) & (F.col(f"label_end_{h}") <= cutoff)
        masked |= {c: F.when(usable, F.col(c)) for c in (f"label_{h}", f"label_end_{h}")}
    return joined.select(*[masked.get(c, F.col(c)).alias(c) for c in labels.columns])


def panel_with_labels(bars: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS) -> DataFrame:
    """Features and forward labels of every row with a full history, from one shuffle."""
    labels = label_columns(horizons)
    rows = with_windows(bars, **labels).where(F.col("_seen") >= MIN_OBSERVATIONS)
    return features_of(rows, *labels)


def panel_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two panels holds more often than the other, with the surplus.

    Empty when the panels are equal as multisets. Both are read once and grouped together.
    """
    both = (a.withColumn("_side", F.lit(1).cast("bigint"))
            .union(b.select(*a.columns).withColumn("_side", F.lit(-1).cast("bigint"))))
    surplus = both.groupBy(*a.columns).agg(F.sum("_side").alias("_side")).where("_side <> 0")
    return surplus.select(*a.columns, F.abs("_side").alias("copies"),
                          F.when(F.col("_side") > 0, "left").otherwise("right").alias("only_in"))
