"""Operators for large training-data pipelines: archives, search, filters, deduplication and formatting.

Nothing outside this subpackage imports it. ``queries`` registers one query per operator.
"""
