"""Queries on the driver tables with their SQL twins."""

from checks import (  # noqa: F401
    q_allelic,
    q_basic,
    q_factor,
    q_joins,
    q_models,
    q_plans,
    q_sources,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
