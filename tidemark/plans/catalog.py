"""All registered queries."""

from tidemark.plans import additive, forecasts, likelihood, reports, shaping, testing  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
