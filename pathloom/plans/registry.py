"""All registered queries and their DuckDB oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import basic, models, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**basic.QUERIES, **relations.QUERIES, **models.QUERIES}
ORACLES: dict[str, str] = {**basic.ORACLES, **relations.ORACLES, **models.ORACLES}
