"""Registered queries over the driver's tables and the SQL that checks them."""

from . import (
    model_queries, panel_queries, portfolio_queries, quality_queries, stream_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "model_queries", "panel_queries", "portfolio_queries",
           "quality_queries", "stream_queries"]
