"""Registered queries and their SQL."""

from . import catalog, evaluation, metadata, relational, retrieval, serving, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
