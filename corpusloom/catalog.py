"""The registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import models, pipelines, relations, scalars, scans  # noqa: F401  they register their queries
from .plans.fixtures import results
from .plans.register import QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.clean_ai_results(results(spark, sf_dir))


def queries() -> dict:
    return {name: function for name, (function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, (_, sql) in QUERIES.items() if sql}
