"""Streams of events: windowed counts with late data, and batches appended to an audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n by tumbling window; events later than the watermark are left out. Also works on batches."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp"))
    counted = timed.withWatermark("_time", late).groupBy(F.window("_time", width), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, key, n by session: events of a key with no longer gap than that."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp"))
    counted = timed.withWatermark("_time", late).groupBy(F.session_window("_time", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the stream to a Parquet table; its checkpoint makes each batch count once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
