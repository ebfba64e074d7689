"""Writes as functions: the table as it is and a change give the table as it will be, and what is affected.

Nothing here touches storage; a Transaction commits the results as snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CheckError, ForeignKeyError, NotNullError, UniqueError


@dataclass
class Change:
    after: DataFrame
    affected: DataFrame


def rows_of(like: DataFrame, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Rows given as mappings, with the columns and types of `like`; columns not given are null."""
    return like.sparkSession.createDataFrame([tuple(r.get(c) for c in like.columns) for r in rows], like.schema)


def insert(current: DataFrame, new: DataFrame) -> Change:
    return Change(current.unionByName(new, allowMissingColumns=True), new)


def with_ids(new: DataFrame, key: str, last: int, order: Sequence[str]) -> DataFrame:
    """New rows numbered on from `last`; one batch of new rows, not the table, is put in order."""
    return new.withColumn(key, (F.row_number().over(Window.orderBy(*order)) + F.lit(last)).cast(dict(new.dtypes)[key] if key in new.columns else "long"))


def update(current: DataFrame, condition: Column, patch: Mapping[str, Any]) -> Change:
    """Sets columns where the condition holds; values are literals or Columns over the old row."""
    hit = F.coalesce(condition, F.lit(False))
    value = lambda c: patch[c] if isinstance(patch[c], Column) else F.lit(patch[c])
    types = dict(current.dtypes)
    after = current.select(*[F.when(hit, value(c).cast(types[c])).otherwise(F.col(c)).alias(c) if c in patch else F.col(c) for c in current.columns])
    return Change(after, current.filter(hit).select(*[value(c).cast(types[c]).alias(c) if c in patch else F.col(c) for c in current.columns]))


def delete(current: DataFrame, condition: Column) -> Change:
    hit = F.coalesce(condition, F.lit(False))
    return Change(current.filter(~hit), current.filter(hit))


def delete_by_keys(current: DataFrame, keys: DataFrame, on: Sequence[str]) -> Change:
    return Change(current.join(keys.select(*on), list(on), "left_anti"), current.join(keys.select(*on).distinct(), list(on), "left_semi"))


def update_by_keys(current: DataFrame, patches: DataFrame, on: Sequence[str]) -> Change:
    """Sets the columns of patches, which holds one row for each key at most."""
    sets = [c for c in patches.columns if c not in on]
    marked = patches.select(*on, *[F.col(c).alias(f"_new_{c}") for c in sets], F.lit(True).alias("_hit"))
    both = current.join(marked, list(on), "left")
    after = both.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in current.columns])
    affected = both.filter("_hit").select(*[F.col(f"_new_{c}").alias(c) if c in sets else F.col(c) for c in current.columns])
    return Change(after, affected)


def last_wins(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last of the rows that share a key."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    return batch.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


def upsert(current: DataFrame, batch: DataFrame, conflict: Sequence[str], update_columns: Sequence[str] | None = None, sequence: str | None = None) -> Change:
    """Inserts rows with new keys, and updates those with known ones.

    By default all given columns outside the key are updated; update_columns narrows that. Where a key
    comes more than once, the row last by `sequence` wins (by all columns, descending, without one).
    """
    order = [F.desc(sequence)] if sequence else [F.desc_nulls_last(c) for c in batch.columns]
    batch = last_wins(batch, conflict, order)
    batch = batch.drop(sequence) if sequence and sequence not in current.columns else batch
    given = [c for c in batch.columns if c not in conflict]
    sets = [c for c in given if update_columns is None or c in update_columns]
    new = lambda c, old: F.when(F.col("_hit") if c in sets else F.col("_old").isNull(), F.col(f"_new_{c}")).otherwise(old)
    return _merged(current, batch, conflict, lambda c, old: new(c, old) if c in given else old)


def _merged(current: DataFrame, batch: DataFrame, conflict: Sequence[str], value: Callable[[str, Column], Column]) -> Change:
    """Rows of either side, met by one outer join; value says of each column outside the key what it becomes.

    _old is set where a row was there before, _hit where the batch has its key, _new_* hold the batch's values.
    A union of known and fresh rows would not do: Spark takes it to be dealt by key as its parts are planned
    to be, and a join of it fails once one part runs as a broadcast join.
    """
    marked = batch.select(*conflict, *[F.col(c).alias(f"_new_{c}") for c in batch.columns if c not in conflict], F.lit(True).alias("_hit"))
    both = current.withColumn("_old", F.lit(True)).join(marked, list(conflict), "full")
    both = both.select(*[(F.col(c) if c in conflict else value(c, F.col(c))).cast(t).alias(c) for c, t in current.dtypes], "_hit")
    return Change(both.drop("_hit"), both.filter("_hit").drop("_hit"))


def add_or_insert(current: DataFrame, batch: DataFrame, conflict: Sequence[str], add: Sequence[str]) -> Change:
    """Rows with known keys get the batch's values of `add` added (null counts as 0) and stay as they are otherwise; the others are inserted.

    Rows of the batch that share a key are summed first; of other columns the greatest value counts.
    """
    rest = [c for c in batch.columns if c not in conflict and c not in add]
    summed = batch.groupBy(*conflict).agg(*[F.sum(c).alias(c) for c in add], *[F.max(c).alias(c) for c in rest])
    more = lambda c: F.coalesce(F.col(f"_new_{c}"), F.lit(0))
    fresh = lambda c, old: F.when(F.col("_old").isNull(), F.col(f"_new_{c}"))
    added = lambda c, old: fresh(c, old).when(F.col("_hit"), F.coalesce(old, F.lit(0)) + more(c)).otherwise(old)
    return _merged(current, summed, conflict, lambda c, old: added(c, old) if c in add else fresh(c, old).otherwise(old) if c in rest else old)


def transition(current: DataFrame, where: Column, from_: str, to: str, column: str = "status", more: Mapping[str, Any] | None = None) -> Change:
    """Compare and set: rows that match where and still have the old status."""
    return update(current, where & (F.col(column) == from_), {column: to, **(more or {})})


def guarded_add(current: DataFrame, where: Column, column: str, amount: float, floor: float = 0) -> Change:
    """Adds to a column where the outcome does not fall below the floor."""
    return update(current, where & (F.col(column) + F.lit(amount) >= F.lit(floor)), {column: F.col(column) + F.lit(amount)})


def state_change(current: DataFrame, where: Column, to: str, allowed: Mapping[str, Sequence[str]], column: str = "status") -> Change:
    """Moves rows to a status where the table of transitions lets their present one go there."""
    return update(current, where & F.col(column).isin([s for s, targets in allowed.items() if to in targets]), {column: to})


def truncate(current: DataFrame) -> Change:
    return Change(current.filter(F.lit(False)), current)


def purge_before(current: DataFrame, column: str, cutoff: Any) -> Change:
    """Removes rows before the cutoff; rows without a value stay."""
    return delete(current, F.col(column) < F.lit(cutoff))


def check_unique(rows: DataFrame, columns: Sequence[str]) -> None:
    """Nulls are never equal."""
    full = rows.filter(reduce(and_, [F.col(c).isNotNull() for c in columns]))
    if not full.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).isEmpty():
        raise UniqueError(f"{', '.join(columns)} must be unique")


def check_foreign_key(rows: DataFrame, column: str, parent: DataFrame, key: str) -> None:
    missing = rows.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
    if not missing.limit(1).isEmpty():
        raise ForeignKeyError(f"{column} refers to a row that is not there")


def violations(rows: DataFrame, required: Sequence[str] = (), checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break, in one pass."""
    broken = [F.when(F.col(c).isNull(), F.lit(f"required:{c}")) for c in required] + [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in (checks or {}).items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).filter(F.size("violations") > 0)


def check_rows(rows: DataFrame, required: Sequence[str] = (), checks: Mapping[str, Column] | None = None) -> None:
    first = violations(rows, required, checks).select("violations").first()
    if first:
        name = first["violations"][0]
        raise (NotNullError if name.startswith("required:") else CheckError)(name)
