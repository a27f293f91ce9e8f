"""All queries of the evaluation engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from . import plans
from .plans import constraints, decisions, geometry, ladders, relational  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict:
    return dict(plans.ORACLES)
