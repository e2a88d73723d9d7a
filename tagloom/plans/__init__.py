"""Registered queries and their SQL."""

from __future__ import annotations

from . import builtins, fusion, observations, readings, stages, values, vectors
from .registry import QUERIES, SQL

__all__ = ["builtins", "fusion", "observations", "readings", "stages", "values", "vectors", "oracle_sql", "queries"]


def queries():
    return QUERIES


def oracle_sql():
    return SQL
