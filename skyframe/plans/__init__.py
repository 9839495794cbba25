"""The registered queries."""

from skyframe.plans import catalogs, relational, scalars, sky  # noqa: F401
from skyframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
