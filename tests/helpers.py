"""Small builders shared by the tests."""

from __future__ import annotations

from datetime import date, timedelta

from barloom.schemas import BARS, RAW_BARS


def d(text: str) -> date:
    return date.fromisoformat(text)


def bars_df(spark, rows):
    return spark.createDataFrame(
        [(s, d(t) if isinstance(t, str) else t, *map(float, v)) for s, t, *v in rows], BARS)


def raw_df(spark, rows):
    return spark.createDataFrame(rows, RAW_BARS)


def random_walk(symbols, sessions, start="2026-01-05", seed=7):
    """Deterministic bars without a random library: a linear congruential walk."""
    rows, state = [], seed
    for s in symbols:
        close = 10.0
        for i in range(sessions):
            state = (state * 1103515245 + 12345) % 2**31
            move = (state / 2**31 - 0.5) / 10
            open_, close = close, round(close * (1 + move), 4)
            high, low = max(open_, close) * 1.01, min(open_, close) * 0.99
            volume = 1000.0 + state % 5000
            rows.append((s, d(start) + timedelta(days=i), open_, high, low, close, volume,
                         volume * (high + low) / 2))
    return rows


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
