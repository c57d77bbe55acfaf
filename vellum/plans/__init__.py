"""Named queries: operators applied to the tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import calls, layout, texts
from vellum.registry import Query

_PARTS = (layout.R, texts.R, calls.R)


def queries() -> dict[str, Query]:
    return {k: q for r in _PARTS for k, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for r in _PARTS for k, q in r.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a question, the eight best sentences with citation tags."""
    return texts.flagship(spark, sf_dir)
