"""Registered queries: each a DataFrame plan, most with equivalent SQL."""

from raterline.plans import calibration, diagnostics, models, relational, robustness  # noqa: F401
from raterline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
