"""Queries of the signal-analytics operators and their SQL oracles."""

from __future__ import annotations

from . import q_decide, q_panel, q_ranks, q_scores, q_summary  # noqa: F401  each registers its queries
from .cohorts import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
