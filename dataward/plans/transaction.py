"""Transactions over snapshots: changes gather in memory as plans and are committed at once.

Nested transactions are savepoints. There are no isolation levels: a transaction reads the version it
started from, and its commit fails if another writer was first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame

from ..errors import TransactionError
from ..session import Session, TableSpec
from ..sources.store import Store


class Transaction:
    def __init__(self, session: Session, store: Store):
        self.store, self.base, self.active = store, store.version(), True
        specs = [TableSpec(n, lambda _, n=n, s=store, v=self.base: s.read(n, v), session.tables[n].key if n in session.tables else ("id",), session.tables[n].required if n in session.tables else ()) for n in store.manifest(self.base)]
        self.session = Session(session.spark, [*[t for n, t in session.tables.items() if n not in {s.name for s in specs}], *specs], session.plugins, session.schema, {})
        self.saved: list[dict[str, DataFrame]] = []

    @property
    def overlay(self) -> dict[str, DataFrame]:
        return self.session.overlay

    def set(self, table: str, df: DataFrame) -> None:
        if not self.active:
            raise TransactionError("the transaction has ended")
        self.overlay[table] = df

    @contextmanager
    def savepoint(self) -> Iterator[Transaction]:
        self.saved.append(dict(self.overlay))
        try:
            yield self
        except BaseException:
            before = self.saved.pop()
            self.overlay.clear()
            self.overlay.update(before)
            raise
        else:
            self.saved.pop()

    def commit(self) -> int:
        self.active = False
        return self.store.commit(self.overlay, self.base) if self.overlay else self.base

    def rollback(self) -> None:
        self.active = False
        self.overlay.clear()


@contextmanager
def transaction(session: Session, store: Store) -> Iterator[Transaction]:
    """Commits when the block ends, rolls back when it raises."""
    work: Any = Transaction(session, store)
    try:
        yield work
    except BaseException:
        work.rollback()
        raise
    else:
        work.commit()
