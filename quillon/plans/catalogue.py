"""Named queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_build, q_data, q_engine, q_eval, q_mix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = q_data.QUERIES | q_eval.QUERIES | q_build.QUERIES | q_mix.QUERIES | q_engine.QUERIES
SQL: dict[str, str] = q_data.SQL | q_eval.SQL | q_build.SQL | q_mix.SQL | q_engine.SQL
