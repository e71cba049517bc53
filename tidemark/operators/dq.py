"""Declared data-quality tests, run for all columns of a table in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, failures: rows where each column is null; one scan for all columns."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("failures")) for c in columns))).alias("p")
    return counts.select(pairs).select("p.column", "p.failures")


def unique(df: DataFrame, column: str) -> DataFrame:
    """column, failures: values that more than one row has; nulls don't count."""
    repeated = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
    return repeated.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(column).alias("column"), "failures")
