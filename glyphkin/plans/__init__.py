"""Queries over the driver's tables, one or more for each operator."""

from . import kernel_queries, page_queries, scan_queries, scoring_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
