"""Registered queries and whole pipelines."""

from tsalign.plans import align_queries, file_queries, series_queries, table_queries, text_queries  # noqa: F401
from tsalign.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
