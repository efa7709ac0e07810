"""Registered queries: every operator applied to the given tables, with the same result written in SQL."""

from sonarium.plans import catalog, cohort, robust, signal, state, text, timed  # noqa: F401
from sonarium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
