"""Analytics on daily stock panels as Spark jobs: DataFrame in, DataFrame out."""

from .operators.bars import as_of, bars_from_ticks, eligible_bars, universe_members
from .operators.calendars import calendar_index, freshness, label_sessions
from .operators.costs import cost_segment_lookup, market_rules_lookup, trade_costs
from .operators.coverage import audit_coverage
from .operators.features import feature_panel, feature_replay, forward_labels, safe_labels
from .operators.model import (
    audit_leaks, fit_multi_horizon, leak_checks, score_panel, training_matrix, walk_forward_split,
)
from .operators.positions import (
    cash_balance, order_screen, position_ledger, rebalance_orders, sellable_shares,
)
from .operators.prices import last_known_close, mark_to_market, nav_metrics
from .operators.quality import normalize_bars
from .operators.ranking import daily_rank, rank_ic, recommend, score_with, top_k_targets
from .operators.signals import (
    binding_issues, portfolio_constraints, resolve_states, signal_chain_audit, target_transition,
)
from .session import build_session
from .sources import (
    dataset_fingerprint, load_dataset, publish_dataset, scan_bars, scan_raw_envelopes,
)

__all__ = [
    "as_of", "audit_coverage", "audit_leaks", "bars_from_ticks", "binding_issues", "build_session",
    "calendar_index", "cash_balance", "cost_segment_lookup", "daily_rank", "dataset_fingerprint",
    "eligible_bars", "feature_panel", "feature_replay", "fit_multi_horizon", "forward_labels",
    "freshness", "label_sessions", "last_known_close", "leak_checks", "load_dataset",
    "mark_to_market", "market_rules_lookup", "nav_metrics", "normalize_bars", "order_screen",
    "portfolio_constraints", "position_ledger", "publish_dataset", "rank_ic", "rebalance_orders",
    "recommend", "resolve_states", "safe_labels", "scan_bars", "scan_raw_envelopes",
    "score_panel", "score_with", "sellable_shares", "signal_chain_audit", "target_transition",
    "top_k_targets", "trade_costs", "training_matrix", "universe_members", "walk_forward_split",
]
