"""Registered queries: every operator with its Spark plan and SQL twin."""

from factorlab.catalog import factors, market, strategies  # noqa: F401
from factorlab.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
