"""What an audit trail says about a window of time."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import period

BUCKETS = 10
#: Bytes that an entry is taken to hold.
ENTRY_BYTES = 500


def window(log: DataFrame, start: Any, end: Any) -> DataFrame:
    return log.filter((F.col("changed_at") >= F.lit(start)) & (F.col("changed_at") < F.lit(end)))


def by_operation(log: DataFrame) -> DataFrame:
    return log.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def top(log: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The column's most frequent values; entries without one count as nothing."""
    return log.groupBy(column).agg(F.count(column).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last()).limit(limit)


def time_buckets(log: DataFrame, end: datetime, length: timedelta, buckets: int = BUCKETS) -> DataFrame:
    """bucket (from 0), n: equal half-open parts of the window before end, in one pass; empty ones show 0."""
    start, width = end - length, length / buckets
    micros = F.unix_micros(F.col("changed_at").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    counts = window(log, start, end).groupBy(F.floor(micros / F.lit(int(width.total_seconds() * 1_000_000))).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = log.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def bucket_label(start: datetime, length: timedelta) -> str:
    """By hour within a day, by date within a month, else by week."""
    if length <= timedelta(days=1):
        return start.strftime("%H:00")
    return start.strftime("%Y-%m-%d") if length <= timedelta(days=30) else f"Week of {start:%Y-%m-%d}"


def per_hour(log: DataFrame, length: timedelta) -> DataFrame:
    return log.agg(F.round(F.count(F.lit(1)) / F.lit(length.total_seconds() / 3600)).cast("long").alias("per_hour"))


def cleanup_preview(log: DataFrame, cutoff: Any) -> DataFrame:
    """n, oldest, newest, size_bytes of what lies before the cutoff."""
    return log.filter(F.col("changed_at") < F.lit(cutoff)).agg(F.count(F.lit(1)).alias("n"), F.min("changed_at").alias("oldest"), F.max("changed_at").alias("newest"), (F.count(F.lit(1)) * ENTRY_BYTES).alias("size_bytes"))


def cleanup_by_table(log: DataFrame, cutoff: Any) -> DataFrame:
    return log.filter(F.col("changed_at") < F.lit(cutoff)).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


def history_summary(log: DataFrame) -> DataFrame:
    """table_name, entity_id, inserts, updates, deletes, days, hours of each entity's history."""
    n = lambda op: F.count(F.when(F.col("operation") == op, 1))
    hours = F.floor((F.unix_seconds(F.max("changed_at").cast("timestamp")) - F.unix_seconds(F.min("changed_at").cast("timestamp"))) / 3600)
    return log.groupBy("table_name", "entity_id").agg(n("INSERT").alias("inserts"), n("UPDATE").alias("updates"), n("DELETE").alias("deletes"), F.floor(hours / 24).alias("days"), F.pmod(hours, F.lit(24)).alias("hours"))


def top_editors(log: DataFrame, limit: int = 3) -> DataFrame:
    return log.groupBy(F.coalesce("changed_by", F.lit("system")).alias("user")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user").limit(limit)


def last(log: DataFrame, text: str, now: datetime) -> DataFrame:
    """The window of that length before now, months of 30 days."""
    return window(log, now - period(text), now)
