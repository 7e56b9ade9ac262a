"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this."""

from tessera.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
