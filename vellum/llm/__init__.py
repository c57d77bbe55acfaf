"""Operators of a training-data pipeline. Nothing else in the library imports them."""

from vellum.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
