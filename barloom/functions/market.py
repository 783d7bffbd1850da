"""Market conventions: units, boards, price limits, lots and the trading day."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHARES_PER_LOT = 100.0
CNY_PER_THOUSAND = 1000.0
STAR_PREFIXES = ("688",)
GEM_PREFIXES = ("300", "301", "302")
LIMIT_TOLERANCE = 1e-9
# Minute of the day at which each part of the trading day starts.
PRE_OPEN = 9 * 60 + 15
MORNING = 9 * 60 + 30
MIDDAY = 11 * 60 + 30
AFTERNOON = 13 * 60
CLOSE = 15 * 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shares_from_lots(vol: Column | str) -> Column:
    return _col(vol) * SHARES_PER_LOT


def amount_from_thousands(amount: Column | str) -> Column:
    return _col(amount) * CNY_PER_THOUSAND


def market(symbol: Column | str) -> Column:
    return F.substring_index(_col(symbol), ".", -1)


def board(symbol: Column | str) -> Column:
    """Rule board of a symbol; ``unsupported`` for the exchange without rules."""
    symbol = _col(symbol)
    code = F.substring(symbol, 1, 3)
    return (
        F.when(market(symbol) == "BJ", "unsupported")
        .when(code.isin(*STAR_PREFIXES), "star")
        .when(code.isin(*GEM_PREFIXES), "gem")
        .otherwise("main")
    )


def limit_up(price: Column, previous_close: Column, pct: Column) -> Column:
    return price >= previous_close * (1 + pct) - LIMIT_TOLERANCE


def limit_down(price: Column, previous_close: Column, pct: Column) -> Column:
    return price <= previous_close * (1 - pct) + LIMIT_TOLERANCE


def execution_price(open_: Column | str, side: Column | str, slippage_bps: float) -> Column:
    """Open moved against the trader by the slippage, buys up and sells down."""
    side = _col(side)
    exact = _col(open_).cast("decimal(30,18)")  # the shortest decimal form of the double
    part = Decimal(str(slippage_bps)) / 10_000
    up, down = (F.lit(str(1 + sign * part)).cast("decimal(10,8)") for sign in (1, -1))
    return (exact * F.when(side == "buy", up).otherwise(down)).cast("double")


def round_lots(shares: Column, lot: Column) -> Column:
    return (F.floor(shares / lot) * lot).cast("bigint")


def session_label(local_time: Column | str, is_session_day: Column) -> Column:
    """Part of the trading day of a local wall-clock time; bounds are half-open."""
    local_time = _col(local_time)
    minute = F.hour(local_time) * 60 + F.minute(local_time)
    return (
        F.when(~F.coalesce(is_session_day, F.lit(False)), "HOLIDAY")
        .when((minute >= PRE_OPEN) & (minute < MORNING), "PRE_OPEN")
        .when((minute >= MORNING) & (minute < MIDDAY), "OPEN")
        .when((minute >= MIDDAY) & (minute < AFTERNOON), "MIDDAY_BREAK")
        .when((minute >= AFTERNOON) & (minute < CLOSE), "OPEN")
        .otherwise("CLOSED")
    )
