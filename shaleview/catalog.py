"""All queries of the general part by name, with their SQL."""

from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
