from .checks import (
    between_dates, finite, non_negative, ohlc_ok, positive, reason, valid_symbol, vendor_date,
    vwap_code,
)
from .market import (
    amount_from_thousands, board, execution_price, limit_down, limit_up, market, round_lots,
    session_label, shares_from_lots,
)
from .runtime import resolve_state
from .text import (
    mask_message, nonfinite_marker, redact_params, row_fingerprint, safe_vendor_code,
    source_columns, url_host,
)

__all__ = [
    "amount_from_thousands", "between_dates", "board", "execution_price", "finite",
    "limit_down", "limit_up", "market", "mask_message", "non_negative", "nonfinite_marker",
    "ohlc_ok", "positive", "reason", "redact_params", "resolve_state", "round_lots",
    "row_fingerprint", "safe_vendor_code", "session_label", "shares_from_lots",
    "source_columns", "url_host", "valid_symbol", "vendor_date", "vwap_code",
]
