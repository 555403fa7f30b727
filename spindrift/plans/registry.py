"""All queries of the core library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.plans import comparisons, files, matrix, problems, relations, reports
from spindrift.streaming import scoring

_MODULES = [problems, reports, matrix, relations, files, comparisons, scoring]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.SQL
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.e_methods(spark, sf_dir)
