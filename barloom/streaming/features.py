"""Trailing features on a stream of bars, equal to the batch panel."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import FEATURE_NAMES, MIN_OBSERVATIONS

BAR_STATE = "trade_date date, high double, low double, close double, volume double, amount double"
FIELDS = ["trade_date", "high", "low", "close", "volume", "amount"]
OUTPUT = ("symbol string, trade_date date, late boolean, "
          + ", ".join(f"{n} double" for n in FEATURE_NAMES))


def trailing_features(history: pd.DataFrame) -> pd.DataFrame:
    """The nine features over date-ordered bars of one symbol."""
    values = feature_arrays(*[history[c].to_numpy(float) for c in FIELDS[1:]])
    return pd.DataFrame({n: values[n] for n in FEATURE_NAMES})


def feature_arrays(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray,
                   amount: np.ndarray) -> dict[str, np.ndarray]:
    """The nine features as arrays; null where a bar has too few before it."""
    def trailing(x: np.ndarray, n: int, of) -> np.ndarray:
        out = np.full(len(x), np.nan)
        if len(x) >= n:
            out[n - 1:] = of(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
        return out

    out = {}
    with np.errstate(all="ignore"):
        for n in (1, 5, 10, 20):
            out[f"ret_{n}d"] = np.full(len(close), np.nan)
            out[f"ret_{n}d"][n:] = close[n:] / close[:-n] - 1
        for n in (5, 20):
            mean = trailing(volume, n, np.mean)
            out[f"vol_ratio_{n}d"] = np.where(mean > 0, volume / mean, 1.0)
        mean, std = trailing(amount, 20, np.mean), trailing(amount, 20, np.std)
        out["amount_z_20d"] = np.where(std > 0, (amount - mean) / std, 0.0)
        top, bottom = trailing(high, 20, np.max), trailing(low, 20, np.min)
        span = top - bottom
        out["close_to_high_20d"] = close / top
        out["range_position_20d"] = np.where(span > 0, (close - bottom) / span, 0.5)
    return out


class TrailingFeatures(StatefulProcessor):
    """Keeps the last 20 bars of a symbol. A bar not after the newest one is late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", BAR_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        symbol, parts = key[0], list(rows)
        incoming = parts[0] if len(parts) == 1 else pd.concat(parts)
        state = list(self.recent.get())
        days = incoming["trade_date"].to_numpy()
        if not pd.isna(days).any():
            order = np.argsort(days, kind="stable")
            days = days[order]
            if (days[1:] > days[:-1]).all() and not (state and days[0] <= max(
                    r[0] for r in state)):
                yield from self.append(symbol, incoming, order, days, state)
                return
        incoming = incoming.sort_values("trade_date", kind="stable")
        kept = pd.DataFrame(state, columns=FIELDS)
        if len(kept):
            newest = kept["trade_date"].max()
            is_late = (incoming["trade_date"] <= newest) | incoming.duplicated("trade_date")
        else:
            is_late = incoming.duplicated("trade_date")
        late, fresh = incoming[is_late], incoming[~is_late]
        if len(late):
            yield pd.DataFrame({"symbol": symbol, "trade_date": late["trade_date"], "late": True,
                                **{n: np.nan for n in FEATURE_NAMES}})
        if not len(fresh):
            return
        history = pd.concat([kept, fresh[FIELDS]] if len(kept) else [fresh[FIELDS]],
                            ignore_index=True)
        last = history.tail(MIN_OBSERVATIONS - 1)
        self.recent.put([tuple(r) for r in last.itertuples(index=False)])
        if len(history) >= MIN_OBSERVATIONS:
            values = trailing_features(history)
            start = max(len(kept), MIN_OBSERVATIONS - 1)
            out = values.iloc[start:].copy()
            out.insert(0, "late", False)
            out.insert(0, "trade_date", history["trade_date"].iloc[start:])
            out.insert(0, "symbol", symbol)
            yield out

    def append(self, symbol, incoming: pd.DataFrame, order: np.ndarray, days: np.ndarray, state):
        """Bars that are all newer than those kept, as arrays."""
        before = list(zip(*state, strict=True)) if state else [()] * len(FIELDS)
        days = np.concatenate([np.array(before[0], dtype=object), days])
        columns = [np.concatenate([np.array(old, float), incoming[c].to_numpy(float)[order]])
                   for c, old in zip(FIELDS[1:], before[1:], strict=True)]
        last = 1 - MIN_OBSERVATIONS
        self.recent.put(list(zip(days[last:], *[c[last:].tolist() for c in columns], strict=True)))
        start = max(len(state), MIN_OBSERVATIONS - 1)
        if len(days) > start:
            values = feature_arrays(*columns)
            yield pd.DataFrame({"symbol": symbol, "trade_date": days[start:], "late": False,
                                **{n: values[n][start:] for n in FEATURE_NAMES}})

    def close(self) -> None:
        pass


def stream_features(bars: DataFrame) -> DataFrame:
    """Features of every new bar with a full history; late bars come out marked."""
    # Ship the processor with the job: the workers need no copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return bars.groupBy("symbol").transformWithStateInPandas(
        TrailingFeatures(), OUTPUT, "Append", "None")
