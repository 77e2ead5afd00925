"""All queries of the engine with their SQL: importing a module of queries registers them."""

from __future__ import annotations

from ringside import prediction_queries, review_queries
from ringside.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "prediction_queries", "review_queries"]
