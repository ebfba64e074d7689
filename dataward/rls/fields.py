"""Field access: who may read and write which columns, and what others see instead."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import AuthContext
from ..errors import PolicyViolationError

Rule = Callable[[AuthContext], Column | bool]
_never: Rule = lambda c: False
_always: Rule = lambda c: True


@dataclass(frozen=True)
class FieldRule:
    read: Rule = _always
    write: Rule = _always
    mask: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class FieldAccess:
    """Rules by column; columns without one follow the default."""

    rules: Mapping[str, FieldRule] = field(default_factory=dict)
    default_allow: bool = True

    def rule(self, column: str) -> FieldRule:
        return self.rules.get(column, FieldRule() if self.default_allow else FieldRule(_never, _never))


def _column(value: Column | bool) -> Column:
    return F.coalesce(value, F.lit(False)) if isinstance(value, Column) else F.lit(value)


def never() -> FieldRule:
    return FieldRule(_never, _never)


def owner_only(owner: str = "owner_id") -> FieldRule:
    own: Rule = lambda c: F.col(owner).cast("string") == str(c.user_id)
    return FieldRule(own, own)


def owner_or_roles(roles: Sequence[str], owner: str = "owner_id") -> FieldRule:
    some: Rule = lambda c: True if c.has_role(*roles) else F.col(owner).cast("string") == str(c.user_id)
    return FieldRule(some, some)


def roles_only(roles: Sequence[str]) -> FieldRule:
    some: Rule = lambda c: c.has_role(*roles)
    return FieldRule(some, some)


def read_only() -> FieldRule:
    return FieldRule(_always, _never)


def public_read(write: Rule = _never) -> FieldRule:
    return FieldRule(_always, write)


def masked(mask: Callable[[Column], Column], read: Rule = _never) -> FieldRule:
    return FieldRule(read, _never, mask)


def mask_frame(df: DataFrame, access: FieldAccess, context: AuthContext, include: Collection[str] | None = None, exclude: Collection[str] = (), omitted_as: str | None = None) -> DataFrame:
    """df as the context may read it.

    A column that nobody in this context may read, and that has no mask, is left out. Where it depends
    on the row, hidden values become null, and omitted_as (if named) lists them.
    """
    if context.is_system:
        return df
    columns, hidden = [], []
    for name in df.columns:
        if (include is not None and name not in include) or name in exclude:
            continue
        rule = access.rule(name)
        may = rule.read(context)
        if may is True:
            columns.append(F.col(name))
            continue
        mask = rule.mask(F.col(name)) if rule.mask else None
        if may is False and mask is None:
            continue
        columns.append(F.when(_column(may), F.col(name)).otherwise(mask if mask is not None else F.lit(None)).alias(name))
        if mask is None:
            hidden.append(F.when(~_column(may), F.lit(name)))
    if omitted_as:
        columns.append((F.array_compact(F.array(*hidden)) if hidden else F.array().cast("array<string>")).alias(omitted_as))
    return df.select(*columns)


def readable_fields(df: DataFrame, access: FieldAccess, context: AuthContext, name: str = "readable") -> DataFrame:
    """df with the names of the columns that may be read of each row."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(_column(access.rule(c).read(context)), F.lit(c)) for c in df.columns])))


def writable_fields(df: DataFrame, access: FieldAccess, context: AuthContext, name: str = "writable") -> DataFrame:
    return df.withColumn(name, F.array_compact(F.array(*[F.when(_column(access.rule(c).write(context)), F.lit(c)) for c in df.columns])))


def check_write(rows: DataFrame, patch: Mapping[str, Any], access: FieldAccess, context: AuthContext) -> None:
    """Raises, naming them, if a column of the patch may not be written in some of the rows."""
    wrong = writable_fields(rows, access, context, "_writable").select(F.array_except(F.array(*[F.lit(c) for c in patch]), F.col("_writable")).alias("w")).filter(F.size("w") > 0).first() if patch else None
    if wrong:
        raise PolicyViolationError(f"columns may not be written: {', '.join(wrong['w'])}")


def writable_patch(patch: Mapping[str, Any], access: FieldAccess, context: AuthContext) -> dict[str, Any]:
    """The patch without the columns that may never be written in this context."""
    return {c: v for c, v in patch.items() if access.rule(c).write(context) is not False}
