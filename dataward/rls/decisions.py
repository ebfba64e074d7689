"""A log of decisions: buffered on the driver, queried as a DataFrame."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Collection
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import context as auth

SCHEMA = "ts timestamp_ntz, table string, operation string, decision string, user_id string, policy string, context string"
# Decisions and operations that statistics always show.
DECISIONS, OPERATIONS = ("allow", "deny", "filter"), ("read", "create", "update", "delete")


class DecisionLog:
    """Keeps up to `buffer` events, or those of `interval` seconds, then hands them to the sink as one DataFrame.

    include names fields of the user's context that are noted as JSON, exclude those that never are.
    """

    def __init__(self, spark: SparkSession, sink: Callable[[DataFrame], None] | None = None, keep: Collection[str] = ("deny",), rate: float = 1.0, buffer: int = 100, tables: dict[str, Collection[str]] | None = None, clock: Callable[[], datetime] | None = None, seed: int = 0, interval: float | None = None, include: Collection[str] = (), exclude: Collection[str] = ()):
        self.spark, self.sink, self.keep, self.rate, self.buffer, self.tables = spark, sink, keep, rate, buffer, tables or {}
        self.clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
        self.interval, self.fields, self.flushed = interval, [f for f in include if f not in exclude], time.monotonic()
        self.waiting: list[tuple[Any, ...]] = []
        self.kept: list[tuple[Any, ...]] = []
        self._random = random.Random(seed)

    def __call__(self, event: dict[str, Any]) -> None:
        if event["decision"] not in self.tables.get(event["table"], self.keep) or self._random.random() >= self.rate:
            return
        context = auth.current()
        noted = {f: getattr(context, f) for f in self.fields if hasattr(context, f)} if context else {}
        self.waiting.append((self.clock(), event["table"], event["operation"], event["decision"], event.get("user_id"), event.get("policy"), json.dumps(noted, default=str) if noted else None))
        if len(self.waiting) >= self.buffer or (self.interval is not None and time.monotonic() - self.flushed >= self.interval):
            self.flush()

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([*self.kept, *self.waiting], SCHEMA)

    def flush(self) -> None:
        if self.waiting and self.sink:
            self.sink(self.spark.createDataFrame(self.waiting, SCHEMA))
        elif self.waiting:
            self.kept = [*self.kept, *self.waiting][-10_000:]
        self.waiting, self.flushed = [], time.monotonic()

    close = flush


def query(events: DataFrame, table: str | None = None, operation: str | None = None, decision: str | None = None, user_id: str | None = None, start: Any = None, end: Any = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filters join; the time range ends before `end`."""
    for column, value in (("table", table), ("operation", operation), ("decision", decision), ("user_id", user_id)):
        events = events.filter(F.col(column) == value) if value is not None else events
    events = events.filter(F.col("ts") >= F.lit(start)) if start is not None else events
    events = events.filter(F.col("ts") < F.lit(end)) if end is not None else events
    if not offset and limit is None:
        return events
    events = events.orderBy("ts").offset(offset)
    return events.limit(limit) if limit is not None else events


def statistics(events: DataFrame) -> DataFrame:
    """kind (decision, operation, table), value, n; decisions and operations without events show 0."""
    spark = events.sparkSession
    fixed = spark.createDataFrame([("decision", v) for v in DECISIONS] + [("operation", v) for v in OPERATIONS], "kind string, value string")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("decision", "operation", "table")]))
    counts = events.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(counts, ["kind", "value"], "full_outer").select("kind", "value", F.coalesce("n", F.lit(0)).alias("n"))
