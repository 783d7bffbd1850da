"""Column predicates of the quality gate. All are null-safe: null counts as bad."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted symbol form and the band around low/high for amount/volume.
SYMBOL_PATTERN = r"^[0-9]{6}\.(SZ|SH|BJ)$"
VWAP_TOLERANCE = 0.05


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_symbol(c: Column | str) -> Column:
    # The pattern's $ also matches before a final newline; the length rules that out.
    c = _col(c)
    return F.coalesce(c.rlike(SYMBOL_PATTERN) & (F.length(c) == 9), F.lit(False))


def vendor_date(c: Column | str) -> Column:
    """Eight digits that name a real day, else null."""
    c = _col(c)
    return F.when(c.rlike("^[0-9]{8}$") & (F.length(c) == 8),
                  F.try_to_date(c, "yyyyMMdd"))


def between_dates(c: Column | str, start, end) -> Column:
    c = _col(c)
    return (c >= F.lit(start).cast("date")) & (c <= F.lit(end).cast("date"))


def finite(c: Column | str) -> Column:
    # isnan first: NaN compares as the largest double.
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def positive(c: Column | str) -> Column:
    return finite(c) & (_col(c) > 0)


def non_negative(c: Column | str) -> Column:
    return finite(c) & (_col(c) >= 0)


def ohlc_ok(open_: Column | str, high: Column | str, low: Column | str,
            close: Column | str) -> Column:
    o, h, lo, c = map(_col, (open_, high, low, close))
    return (lo <= h) & (lo <= F.least(o, c)) & (h >= F.greatest(o, c))


def vwap_code(low: Column | str, high: Column | str, volume: Column | str,
              amount: Column | str) -> Column:
    """Reason code of the turnover check, null when it holds."""
    lo, h, v, a = map(_col, (low, high, volume, amount))
    vwap = F.when(v != 0, a / v)
    floor, ceiling = lo * (1.0 - VWAP_TOLERANCE), h * (1.0 + VWAP_TOLERANCE)
    return (
        F.when((v == 0) != (a == 0), "INCONSISTENT_ZERO_TURNOVER")
        .when(v == 0, F.lit(None).cast("string"))
        .when(~positive(vwap), "INVALID_IMPLIED_VWAP")
        .when(~finite(floor) | ~finite(ceiling), "VWAP_BOUND_OVERFLOW")
        .when((vwap < floor) | (vwap > ceiling), "VWAP_OUTSIDE_OHLC_BAND")
    )


def reason(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that fires, in the order given; null when none does."""
    out = None
    for failed, code in rules:
        out = F.when(failed, code) if out is None else out.when(failed, code)
    return out
