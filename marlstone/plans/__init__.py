"""Queries composed from the operators, with their SQL."""

from marlstone.plans import data_queries, search_queries, text_queries
from marlstone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "data_queries", "search_queries", "text_queries"]
