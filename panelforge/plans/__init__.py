"""Registered queries: importing this package registers them."""

from . import queries_data, queries_models, queries_risk  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
