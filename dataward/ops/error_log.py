"""What a log of errors (id, ts, error, query, table_name, operation, user_id) says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import error_fingerprint, error_kind

EXAMPLES, HOURS = 3, 24


def patterns(log: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """pattern, n, first_seen, last_seen, n_tables, n_users and the ids of the newest examples.

    Examples are cut by rank before anything is gathered, so a common pattern gathers no more than a rare one.
    """
    rows = log.withColumn("pattern", error_fingerprint(F.col("error")))
    figures = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("table_name").alias("n_tables"), F.count_distinct("user_id").alias("n_users"))
    newest = Window.partitionBy("pattern").orderBy(F.desc("ts"), F.desc("id"))
    some = rows.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= examples)
    some = some.groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "id"))), lambda x: x["id"].cast("string")), ",").alias("examples"))
    return figures.join(some, "pattern")


def by_table(log: DataFrame) -> DataFrame:
    return log.filter(F.col("table_name").isNotNull()).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


def by_operation(log: DataFrame) -> DataFrame:
    """operation, n, pct of all errors to one place."""
    rows = log.groupBy(F.coalesce("operation", F.lit("unknown")).alias("operation")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def by_user(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.groupBy(F.coalesce(F.col("user_id").cast("string"), F.lit("system")).alias("user_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(limit)


def by_hour(log: DataFrame, hours: int = HOURS) -> DataFrame:
    """The last hours that have errors, in order."""
    rows = log.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("hour")).limit(hours).orderBy("hour")


def kinds(log: DataFrame, limit: int = 5) -> DataFrame:
    return log.groupBy(error_kind(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(limit)


def alerts(log: DataFrame, least: int = 10) -> DataFrame:
    """Kinds of errors that call for attention, by number."""
    rows = log.groupBy(error_kind(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    urgent = F.col("kind").isin("Connection Error", "Timeout Error", "Permission Error")
    return rows.filter(urgent & (F.col("n") >= least)).withColumn("alert", F.concat("kind", F.lit(": "), F.col("n").cast("string")))
