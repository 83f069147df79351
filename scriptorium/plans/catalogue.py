"""Every registered query of the engine with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import feeds, graph, pages, reports, search, streams, text, trends

_PARTS = (text, search, graph, trends, pages, reports, streams, feeds)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.SQL.items()}
