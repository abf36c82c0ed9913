"""Collects the queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query, and the SQL that gives the same rows where SQL can."""

    def add(query):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql:
            _ORACLES[name] = sql
        return query

    return add


def _load() -> None:
    from . import casebook, census, checks, coverage, diffing, documents, files, governance, imports, lookups, paths, planning, privacy, proposals, quality, reports, residual, risks, scalars, scraps, teaching  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
