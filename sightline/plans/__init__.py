"""Registered queries over the given tables."""

from . import code_queries, report_queries, rule_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "code_queries", "report_queries"]
