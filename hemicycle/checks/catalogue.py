"""Every registered query with its SQL, gathered from the check modules."""

from hemicycle.checks import ensemble_queries, ingest_queries, plan_queries, seat_queries  # noqa: F401
from hemicycle.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
