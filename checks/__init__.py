"""Query registry: every operator bound to the test tables, with its SQL counterpart."""

from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
