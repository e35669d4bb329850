"""All queries of the engine."""

from . import diagnostics, evaluation, exchange, features, histories, relational, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
