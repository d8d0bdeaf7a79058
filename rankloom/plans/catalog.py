"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.plans import alignment, boards, extras, preparation, records, rules, study

_MODULES = (alignment, boards, extras, preparation, records, study, rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.ag8_point_metrics(spark, sf_dir)
