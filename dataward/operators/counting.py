"""Counts and existence."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .where import compile_where


def count_rows(df: DataFrame, where: Mapping[str, Any] | None = None) -> int:
    return df.filter(compile_where(where, df.columns)).count()


def count_frame(df: DataFrame, where: Mapping[str, Any] | None = None, name: str = "n") -> DataFrame:
    """The count as a one-row DataFrame, for use in further plans."""
    return df.filter(compile_where(where, df.columns)).agg(F.count(F.lit(1)).alias(name))


def exists(df: DataFrame, where: Mapping[str, Any] | None = None) -> bool:
    """Stops at the first row found."""
    return not df.filter(compile_where(where, df.columns)).limit(1).isEmpty()


def grouped(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """value, n: counts by the column's value as text; null goes by "null"."""
    return grouped(df.select(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")), "value")


def grouped_counts(df: DataFrame, column: str) -> dict[str, int]:
    """group_sizes() as a mapping, for columns of few values."""
    return {r["value"]: r["n"] for r in group_sizes(df, column).collect()}


def distinct_count(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """The count of a DISTINCT subquery."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias(name))
