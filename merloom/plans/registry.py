"""All core queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merloom.plans import files, identification, indexing, ordered, sequences, skew, streams, taxonomy

MODULES = [skew, sequences, indexing, identification, taxonomy, files, ordered, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return identification.identify_hits(spark, d)
