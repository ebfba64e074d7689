"""Rows that are marked as deleted, hidden from reads, and can be restored."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import NotFoundError, RecordNotDeletedError
from ..operators import writes
from ..operators.where import applies_to_table
from .base import FILTER, Plugin, QueryContext


def active(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNull())


def deleted(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


class SoftDelete(Plugin):
    name, priority = "soft-delete", FILTER

    def __init__(self, column: str = "deleted_at", only: Collection[str] | None = None, without: Collection[str] | None = None, include_deleted: bool = False, clock: Callable[[], Any] | None = None):
        self.column, self.only, self.without, self.include_deleted = column, only, without, include_deleted
        self.clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def applies(self, table: str, columns: Collection[str]) -> bool:
        return applies_to_table(table, self.only, self.without) and self.column in columns

    def intercept(self, df: DataFrame, context: QueryContext, session: Any) -> DataFrame:
        hidden = not (self.include_deleted or context.metadata.get("include_deleted"))
        return active(df, self.column) if hidden and context.operation == "select" and self.applies(context.table, df.columns) else df

    def extend(self, repository: Any) -> Any:
        if self.applies(repository.name, repository.raw.columns):
            repository.soft = SoftDeleteMethods(repository, self)
        return repository


class SoftDeleteMethods:
    """What repositories gain: soft_delete, restore, hard_delete and reads of what is hidden."""

    def __init__(self, repository: Any, plugin: SoftDelete):
        self.repository, self.plugin = repository, plugin

    def soft_delete(self, key: Any) -> Row:
        return self.repository.update(key, {self.plugin.column: self.plugin.clock()})

    def restore(self, key: Any) -> Row:
        row = self.repository.raw.filter(self.repository._key(key)).first()
        if row is None:
            raise NotFoundError(f"{self.repository.name}: no such row")
        if row[self.plugin.column] is None:
            raise RecordNotDeletedError(f"{self.repository.name}: the row is not deleted")
        return self.repository.update(key, {self.plugin.column: None})

    def hard_delete(self, key: Any) -> bool:
        return self.repository.delete(key)

    def hard_delete_many(self, keys: Sequence[Any]) -> int:
        return self.repository.delete_many(keys)

    def _set_many(self, keys: Sequence[Any], value: Any) -> DataFrame:
        there = self.repository.raw.join(self.repository._keys(keys), list(self.repository.spec.key), "left_semi").select(*self.repository.spec.key).collect()
        return self.repository.update_many([r.asDict() for r in there], {self.plugin.column: value})

    def soft_delete_many(self, keys: Sequence[Any]) -> DataFrame:
        """In one write; keys that are not there are passed over."""
        return self._set_many(keys, self.plugin.clock())

    def restore_many(self, keys: Sequence[Any]) -> DataFrame:
        return self._set_many(keys, None)

    def find_with_deleted(self, key: Any) -> Row | None:
        return self.repository.raw.filter(self.repository._key(key)).first()

    def find_all_with_deleted(self) -> DataFrame:
        return self.repository.raw

    def find_deleted(self) -> DataFrame:
        return deleted(self.repository.raw, self.plugin.column)

    def purge(self) -> writes.Change:
        """Removes what is marked as deleted: a delete like any other, with guards and records."""
        current = self.repository.raw
        write = self.repository._write("delete", before=deleted(current, self.plugin.column))
        return self.repository._run(write, lambda: writes.delete(current, F.col(self.plugin.column).isNotNull()))
