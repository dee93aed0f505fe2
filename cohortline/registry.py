"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import modelling, signals, trajectory

_MODULES = [trajectory, signals, modelling]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
