"""Repositories: reads, pages, counts and governed writes of one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import BadRequestError, NotFoundError
from ..operators import counting, paging, writes
from ..operators.where import compile_where, equalities, has_operators
from ..session import Session, TableSpec

#: Keys up to this many go into the plan as literals, more as a joined table.
LITERAL_KEYS = 1000


@dataclass
class Write:
    """A write on its way through guard, stamp, write and record."""

    operation: str
    table: str
    session: Session
    key: tuple[str, ...]
    before: DataFrame | None = None
    after: DataFrame | None = None
    patch: dict[str, Any] = field(default_factory=dict)
    #: The columns that the caller sets, before any stamps.
    given: tuple[str, ...] = ()
    flags: dict[str, Any] = field(default_factory=dict)


@dataclass
class Repository:
    session: Session
    spec: TableSpec
    checks: dict[str, Column] = field(default_factory=dict)
    map_row: Callable[[DataFrame], DataFrame] | None = None
    flags: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.spec.name

    @property
    def raw(self) -> DataFrame:
        return self.session.raw(self.name)

    @property
    def rows(self) -> DataFrame:
        df = self.session.table(self.name, **self.flags)
        return self.map_row(df) if self.map_row else df

    def _key(self, key: Any) -> Column:
        if isinstance(key, Mapping):
            if missing := [c for c in self.spec.key if c not in key]:
                raise BadRequestError(f"the key lacks {', '.join(missing)}")
            return reduce(and_, [F.col(c) == F.lit(key[c]) for c in self.spec.key])
        if len(self.spec.key) > 1:
            raise BadRequestError(f"the key has columns {', '.join(self.spec.key)}")
        return F.col(self.spec.key[0]) == F.lit(key)

    def _keys(self, keys: Sequence[Any]) -> DataFrame:
        rows = [tuple(k[c] for c in self.spec.key) if isinstance(k, Mapping) else (k,) for k in keys]
        schema = self.raw.select(*self.spec.key).schema
        return self.session.spark.createDataFrame(rows, schema).distinct()

    # Reads

    def find_all(self) -> DataFrame:
        return self.rows

    def find_by_id(self, key: Any) -> Row | None:
        return self.rows.filter(self._key(key)).first()

    def find_by_ids(self, keys: Sequence[Any]) -> DataFrame:
        """Rows with one of the keys; keys given twice do not double rows."""
        if not keys:
            return self.rows.filter(F.lit(False))
        if len(self.spec.key) == 1 and len(keys) <= LITERAL_KEYS:
            return self.rows.filter(F.col(self.spec.key[0]).isin(list(keys)))
        return self.rows.join(self._keys(keys), list(self.spec.key), "left_semi")

    def find(self, where: Mapping[str, Any] | None = None, sort: paging.Order = (), order_by: str | None = None, direction: str = "asc", select: Sequence[str] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
        df = self.rows
        plain = not (sort or order_by or select or limit is not None or offset is not None or has_operators(where or {}))
        df = df.filter(equalities(where) if plain else compile_where(where, df.columns))
        order = list(sort) or ([(order_by, direction)] if order_by else [])
        limited = limit is not None or offset is not None
        df = paging.ordered(df, order, self.spec.key if order or limited else ())
        df = df.offset(offset) if offset is not None else df
        df = df.limit(limit) if limit is not None else df
        return df.select(*select) if select else df

    def find_one(self, where: Mapping[str, Any] | None = None, **options: Any) -> Row | None:
        return self.find(where, **options).first()

    def find_one_by(self, column: str, value: Any) -> Row | None:
        return self.rows.filter(equalities({column: value})).first()

    def find_many_by(self, column: str, value: Any, order_by: str | None = None, direction: str = "desc", limit: int | None = None, offset: int | None = None) -> DataFrame:
        df = self.rows.filter(equalities({column: value}))
        df = paging.ordered(df, [(order_by, direction)] if order_by else [], self.spec.key if order_by else ())
        return paging.apply_offset(df, limit, offset)

    def count(self, where: Mapping[str, Any] | None = None) -> int:
        return counting.count_rows(self.rows, where)

    def exists(self, where: Mapping[str, Any] | None = None) -> bool:
        return counting.exists(self.rows, where)

    def find_and_count(self, where: Mapping[str, Any] | None = None, **options: Any) -> tuple[DataFrame, int]:
        """A page and the count of all that match, from one version of the table."""
        return self.find(where, **options), self.count(where)

    def paginate(self, limit: int, offset: int = 0, order_by: str | None = None, direction: str = "asc") -> tuple[DataFrame, int]:
        """A page and the count of all rows."""
        return self.find(order_by=order_by or self.spec.key[0], direction=direction, limit=limit, offset=offset), self.rows.count()

    def paginate_cursor(self, order_by: str | None = None, direction: str = "asc", cursor: str | None = None, limit: int = paging.DEFAULT_LIMIT, where: Mapping[str, Any] | None = None, security: paging.CursorSecurity | None = None) -> paging.CursorPage:
        """Pages by a column, with all key columns ascending after it."""
        order = [(order_by, direction)] if order_by and order_by not in self.spec.key else []
        order += [(k, direction if k == order_by else "asc") for k in self.spec.key]
        df = self.rows
        return paging.paginate_cursor(df.filter(compile_where(where, df.columns)), order, cursor, limit, security)

    # Writes: guard, stamp, write, record

    def _run(self, write: Write, plan: Callable[[], writes.Change], check: Callable[[writes.Change], None] | None = None) -> writes.Change:
        """Guards see the rows as they were and as they will be; nothing is written if one of them, or the check, objects."""
        for p in self.session.plugins:
            p.stamp(write)
        change = plan()
        write.after = change.affected if write.operation != "delete" else None
        for p in self.session.plugins:
            p.guard(write)
        if check:
            check(change)
        self.session.overlay[self.name] = change.after
        for p in self.session.plugins:
            p.record(write)
        return change

    def _write(self, operation: str, **more: Any) -> Write:
        return Write(operation, self.name, self.session, self.spec.key, flags=dict(self.flags), **more)

    def create_many(self, rows: Sequence[Mapping[str, Any]] | DataFrame) -> DataFrame:
        current = self.raw
        new = rows if isinstance(rows, DataFrame) else writes.rows_of(current, rows)
        given = tuple(new.columns) if isinstance(rows, DataFrame) else tuple(dict.fromkeys(c for r in rows for c in r))
        write = self._write("create", after=new, given=given)
        if len(self.spec.key) == 1 and not isinstance(rows, DataFrame) and any(r.get(self.spec.key[0]) is None for r in rows):
            key = self.spec.key[0]
            last = current.agg(F.max(key)).first()[0] or 0
            write.after = writes.rows_of(current, [{**r, key: r.get(key) if r.get(key) is not None else last + i + 1} for i, r in enumerate(rows)])

        def check(change: writes.Change) -> None:
            writes.check_rows(change.affected, self.spec.required, self.checks)
            self._check_keys(change)

        return self._run(write, lambda: writes.insert(current, write.after), check).affected

    def _check_keys(self, change: writes.Change) -> None:
        """Only rows that share a key with an affected one can break its uniqueness."""
        keys = list(self.spec.key)
        writes.check_unique(change.after.select(*keys).join(change.affected.select(*keys), keys, "left_semi"), self.spec.key)

    def create(self, row: Mapping[str, Any]) -> Row:
        return self.create_many([row]).first()

    def update(self, key: Any, patch: Mapping[str, Any]) -> Row:
        return self._update(self._key(key), patch, 1).first()

    def update_many(self, keys: Sequence[Any], patch: Mapping[str, Any]) -> DataFrame:
        """All of the keys or, if one is missing, none."""
        if not keys:
            return self.raw.filter(F.lit(False))
        condition = reduce(lambda a, b: a | b, [self._key(k) for k in keys])
        return self._update(condition, patch, len({str(k) for k in keys}))

    def _update(self, condition: Column, patch: Mapping[str, Any], expected: int) -> DataFrame:
        current = self.raw
        before = current.filter(condition)
        if before.count() < expected:
            raise NotFoundError(f"{self.name}: not all rows to update are there")
        write = self._write("update", before=before, patch=dict(patch), given=tuple(patch))
        return self._run(write, lambda: writes.update(current, condition, write.patch), self._check_rows).affected

    def _check_rows(self, change: writes.Change) -> None:
        writes.check_rows(change.affected, self.spec.required, self.checks)

    def delete(self, key: Any) -> bool:
        return self.delete_many([key]) > 0

    def delete_many(self, keys: Sequence[Any]) -> int:
        """The number of rows removed."""
        if not keys:
            return 0
        current, on = self.raw, self._keys(keys)
        before = current.join(on, list(self.spec.key), "left_semi")
        found = before.count()
        if found:
            self._run(self._write("delete", before=before), lambda: writes.delete_by_keys(current, on, self.spec.key))
        return found

    def upsert(self, rows: Sequence[Mapping[str, Any]] | DataFrame, conflict: Sequence[str] | None = None, update_columns: Sequence[str] | None = None) -> DataFrame:
        current = self.raw
        if not isinstance(rows, DataFrame):
            if not rows:
                return current.filter(F.lit(False))
            columns = list(rows[0])
            batch = writes.rows_of(current.select(*columns), rows)
            numbered = [(*[r.get(c) for c in columns], i) for i, r in enumerate(rows)]
            batch = self.session.spark.createDataFrame(numbered, batch.schema.add("_sequence", "long"))
        else:
            batch = rows
        on = list(conflict or self.spec.key)
        write = self._write("upsert", before=current.join(batch.select(*on), on, "left_semi"), after=batch, given=tuple(c for c in batch.columns if c != "_sequence"))

        def check(change: writes.Change) -> None:
            self._check_rows(change)
            if set(on) != set(self.spec.key):
                self._check_keys(change)

        return self._run(write, lambda: writes.upsert(current, write.after, on, update_columns, "_sequence" if "_sequence" in batch.columns else None), check).affected

    def add_or_insert(self, rows: Sequence[Mapping[str, Any]], add: Sequence[str], conflict: Sequence[str] | None = None) -> DataFrame:
        """Adds columns of the rows to those of the known rows with their keys, and inserts the others."""
        current, on = self.raw, list(conflict or self.spec.key)
        if not rows:
            return current.filter(F.lit(False))
        batch = writes.rows_of(current.select(*rows[0]), rows)
        write = self._write("upsert", before=current.join(batch.select(*on), on, "left_semi"), after=batch, given=tuple(batch.columns))

        def check(change: writes.Change) -> None:
            self._check_rows(change)
            self._check_keys(change)

        return self._run(write, lambda: writes.add_or_insert(current, write.after, on, add), check).affected

    def transition(self, where: Mapping[str, Any], from_: str, to: str, column: str = "status", more: Mapping[str, Any] | None = None) -> Row | None:
        """Compare and set of a status; None if no row matched."""
        current = self.raw
        hit = compile_where(where, current.columns) & (F.col(column) == from_)
        before, patch = current.filter(hit), {column: to, **(more or {})}
        if before.isEmpty():
            return None
        write = self._write("update", before=before, patch=patch, given=tuple(patch))
        return self._run(write, lambda: writes.update(current, hit, write.patch), self._check_rows).affected.first()
