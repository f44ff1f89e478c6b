"""Registered queries of the engine."""

from . import build_queries, math_queries, record_queries, text_queries  # noqa: F401
from .core import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
