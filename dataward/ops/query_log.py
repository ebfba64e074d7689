"""What a log of queries (query_text, duration_ms, error, executed_at) says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import floor_index, percentile_disc
from ..functions.text import query_fingerprint, query_verb

# Milliseconds from which a query counts as slow, for metrics and for analysis.
SLOW_METRIC, SLOW_QUERY = 100, 1000


def fingerprints(log: DataFrame, limit: int | None = 10) -> DataFrame:
    duration = F.coalesce("duration_ms", F.lit(0.0))
    found = log.groupBy(query_fingerprint(F.col("query_text")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(duration), 4).alias("total_ms"), F.round(F.avg(duration), 4).alias("avg_ms"), F.max(duration).alias("max_ms"))
    return found.orderBy(F.desc("n"), "fingerprint").limit(limit) if limit is not None else found


def statistics(log: DataFrame) -> DataFrame:
    """n, success_pct, avg_ms, p95_ms (at floor(n * p)), per_minute."""
    minutes = (F.unix_micros(F.max("executed_at").cast("timestamp")) - F.unix_micros(F.min("executed_at").cast("timestamp"))) / 60e6
    return log.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.count(F.when(F.col("error").isNull(), 1)) / F.count(F.lit(1)), 2).alias("success_pct"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), floor_index(log, "duration_ms", 0.95).alias("p95_ms"), F.round(F.count(F.lit(1)) / F.when(minutes > 0, minutes), 4).alias("per_minute"))


def slow(log: DataFrame, limit: int = 5, over: float = SLOW_QUERY) -> DataFrame:
    return log.filter(F.col("duration_ms") > over).orderBy(F.desc("executed_at"), "id").limit(limit)


def failed(log: DataFrame, limit: int = 5) -> DataFrame:
    return log.filter(F.col("error").isNotNull()).orderBy(F.desc("executed_at"), "id").limit(limit)


def verbs(log: DataFrame) -> DataFrame:
    return log.groupBy(query_verb(F.col("query_text")).alias("verb")).agg(F.count(F.lit(1)).alias("n"))


def metrics(log: DataFrame, threshold: float = SLOW_METRIC) -> DataFrame:
    """total, avg_ms, min_ms, max_ms, p95_ms, p99_ms (nearest rank), slow; figures to two places."""
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("duration_ms"), 2).alias("avg_ms"),
        F.round(F.min("duration_ms"), 2).alias("min_ms"),
        F.round(F.max("duration_ms"), 2).alias("max_ms"),
        F.round(percentile_disc("duration_ms", 0.95), 2).alias("p95_ms"),
        F.round(percentile_disc("duration_ms", 0.99), 2).alias("p99_ms"),
        F.count(F.when(F.col("duration_ms") > threshold, 1)).alias("slow"),
    )


def recommendations(figures: DataFrame, threshold: float = SLOW_METRIC, pool_use: float | None = None) -> DataFrame:
    """figures of metrics() with the advice that follows from them."""
    advice = [
        F.when(F.col("slow") > 0.1 * F.col("total"), "many slow queries: look at their plans"),
        F.when(F.col("avg_ms") > 0.5 * threshold, "high average duration: look at partitioning and pruning"),
        F.when(F.lit((pool_use or 0) > 0.8), "executors nearly all busy: add some"),
    ]
    return figures.withColumn("advice", F.array_compact(F.array(*advice)))


def profile(log: DataFrame) -> DataFrame:
    """runs, mean_ms, stddev_ms (of the population), p50_ms, p95_ms, p99_ms (at floor(n * p))."""
    return log.agg(F.count("duration_ms").alias("runs"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.round(F.stddev_pop("duration_ms"), 4).alias("stddev_ms"), *[floor_index(log, "duration_ms", p / 100).alias(f"p{p}_ms") for p in (50, 95, 99)])


def summary(log: DataFrame) -> DataFrame:
    """n, total_ms, avg_ms, slowest and fastest query; the first of equals."""
    slowest = F.min_by("query_text", F.struct(-F.col("duration_ms"), F.col("id")))
    return log.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_ms"), 4).alias("total_ms"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), slowest.alias("slowest"), F.min_by("query_text", F.struct("duration_ms", "id")).alias("fastest"))
