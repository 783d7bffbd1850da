"""Join and scan helpers that hold one plan at every size."""

from .joins import intervals_at, spread
from .ordered import ordered_scan

__all__ = ["intervals_at", "ordered_scan", "spread"]
