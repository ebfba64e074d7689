"""created_at and updated_at, filled in by writes."""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import since
from ..operators.where import applies_to_table
from .base import TRANSFORM, Plugin

SOURCES: dict[str, Callable[[], Any]] = {
    "iso": lambda: datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
    "unix": lambda: int(time.time()),
    "date": lambda: datetime.now(timezone.utc).replace(tzinfo=None),
}


def created_after(df: DataFrame, moment: Any, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column) > F.lit(moment))


def created_before(df: DataFrame, moment: Any, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column) < F.lit(moment))


def created_between(df: DataFrame, start: Any, end: Any, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))


def updated_after(df: DataFrame, moment: Any, column: str = "updated_at") -> DataFrame:
    return df.filter(F.col(column) > F.lit(moment))


def most_recent(df: DataFrame, column: str, limit: int = 10, tie_break: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *tie_break).limit(limit)


def by_timestamp(df: DataFrame, column: str = "created_at", last: str | None = None, start: Any = None, end: Any = None, direction: str = "desc", limit: int = 100, now: datetime | None = None, tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows of a range of time, both ends included: of the last 24h, 7d, 2w or 1m, or from start to end."""
    if last is not None:
        end = now or datetime.now(timezone.utc).replace(tzinfo=None)
        start = since(last, end, run_over=True)
    df = df.filter(F.col(column) >= F.lit(start)) if start is not None else df
    df = df.filter(F.col(column) <= F.lit(end)) if end is not None else df
    order = F.col(column).desc_nulls_last() if direction == "desc" else F.col(column).asc_nulls_last()
    return df.orderBy(order, *tie_break).limit(limit)


class Timestamps(Plugin):
    name, priority = "timestamps", TRANSFORM

    def __init__(self, created: str = "created_at", updated: str = "updated_at", on_insert_too: bool = False, source: str | Callable[[], Any] = "date", only: Collection[str] | None = None, without: Collection[str] | None = None):
        self.created, self.updated, self.on_insert_too, self.only, self.without = created, updated, on_insert_too, only, without
        self.now = SOURCES[source] if isinstance(source, str) else source

    def stamp(self, write: Any) -> None:
        if not applies_to_table(write.table, self.only, self.without) or write.flags.get("without_timestamps"):
            return
        now = self.now()
        if write.operation in ("create", "upsert") and write.after is not None:
            for column, wanted in ((self.created, True), (self.updated, self.on_insert_too)):
                if wanted and column in write.after.columns:
                    kind = dict(write.after.dtypes)[column]
                    write.after = write.after.withColumn(column, F.coalesce(F.col(column), F.lit(now).cast(kind)))
        elif write.operation == "update" and self.updated in write.before.columns:
            write.patch.setdefault(self.updated, now)

    def extend(self, repository: Any) -> Any:
        if self.created in repository.raw.columns and applies_to_table(repository.name, self.only, self.without):
            repository.timestamps = TimestampMethods(repository, self)
        return repository


class TimestampMethods:
    def __init__(self, repository: Any, plugin: Timestamps):
        self.repository, self.plugin = repository, plugin

    def columns(self) -> dict[str, str]:
        return {"created": self.plugin.created, "updated": self.plugin.updated}

    def find_created_after(self, moment: Any) -> DataFrame:
        return created_after(self.repository.rows, moment, self.plugin.created)

    def find_created_before(self, moment: Any) -> DataFrame:
        return created_before(self.repository.rows, moment, self.plugin.created)

    def find_created_between(self, start: Any, end: Any) -> DataFrame:
        return created_between(self.repository.rows, start, end, self.plugin.created)

    def find_updated_after(self, moment: Any) -> DataFrame:
        return updated_after(self.repository.rows, moment, self.plugin.updated)

    def find_recently_created(self, limit: int = 10) -> DataFrame:
        return most_recent(self.repository.rows, self.plugin.created, limit, self.repository.spec.key)

    def find_recently_updated(self, limit: int = 10) -> DataFrame:
        return most_recent(self.repository.rows, self.plugin.updated, limit, self.repository.spec.key)

    def touch_many(self, keys: Sequence[Any]) -> DataFrame:
        """One time for all of them."""
        return self.repository.update_many(keys, {self.plugin.updated: self.plugin.now()})

    def without(self) -> Any:
        """The repository with stamping left out."""
        from dataclasses import replace

        return replace(self.repository, flags={**self.repository.flags, "without_timestamps": True})
