"""Queries by name, each over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import art, collections, jobs, questions, ranking, reports, search
from quire.plans.registry import QUERIES, SQL

__all__ = ["art", "collections", "jobs", "questions", "ranking", "reports", "search", "queries", "oracle_sql"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
