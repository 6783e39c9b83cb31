"""Registered queries and their SQL."""

from . import orbit_queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "orbit_queries"]
