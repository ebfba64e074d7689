"""An audit trail of row images, and what can be told from it: history, diffs, states and restores."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import context as auth
from ..errors import AuditMissingValuesError, AuditRestoreError, NotFoundError
from ..operators import paging, writes
from ..operators.where import applies_to_table
from .base import AUDIT, Plugin

OPERATIONS = {"create": "INSERT", "update": "UPDATE", "delete": "DELETE"}
COLUMNS = ("id", "table_name", "entity_id", "operation", "old_values", "new_values", "changed_by", "changed_at", "metadata")
LOG_SCHEMA = "id long, table_name string, entity_id string, operation string, old_values string, new_values string, changed_by string, changed_at timestamp_ntz, metadata string"
#: An entry's id is its write's number, with place for so many bits of its row's number below.
ROW_BITS, GROUPS = 40, 1024
FIELDS = "map<string,string>"


def image(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as JSON text, nulls and all."""
    return F.to_json(F.struct(*[F.col(c) for c in columns or df.columns]), {"ignoreNullFields": "false"})


def entity_id(key: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in key])


def diff_entries(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """entity_id, operation, old_values, new_values for each row that came, went or changed."""
    old = before.select(*key, image(before).alias("old_values"))
    new = after.select(*key, image(after).alias("new_values"))
    both = old.join(new, list(key), "full_outer")
    operation = F.when(F.col("old_values").isNull(), "INSERT").when(F.col("new_values").isNull(), "DELETE").otherwise("UPDATE")
    return both.filter(~F.col("old_values").eqNullSafe(F.col("new_values"))).select(entity_id(key).alias("entity_id"), operation.alias("operation"), "old_values", "new_values")


def with_ids(entries: DataFrame, batch: int) -> DataFrame:
    """entries of one write (one for each entity) with ids: rows are numbered within groups by hash, so no task numbers them all."""
    group = F.pmod(F.xxhash64("entity_id"), F.lit(GROUPS))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("entity_id")) - 1
    return entries.withColumn("id", F.lit(batch << ROW_BITS) + nth.cast("long") * GROUPS + group)


class Audit(Plugin):
    """Keeps entries as a DataFrame; `sink` gets each write's entries, by default they gather in entries.

    `log` gives the log stored so far, so that ids go on from it; `metadata` what is noted with each write.
    """

    name, priority = "audit", AUDIT

    def __init__(self, only: Collection[str] | None = None, without: Collection[str] | None = None, user: Callable[[], Any] | None = None, clock: Callable[[], datetime] | None = None, sink: Callable[[DataFrame], None] | None = None, log: Callable[[], DataFrame] | None = None, metadata: Callable[[], Mapping[str, Any]] | None = None):
        self.only, self.without, self.sink, self.log, self.metadata = only, without, sink, log, metadata
        self.batch: int | None = None
        self.user = user or (lambda: str(c.user_id) if (c := auth.current()) else None)
        self.clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
        self.entries: DataFrame | None = None

    def _next(self) -> int:
        if self.batch is None:
            last = self.log().agg(F.max("id")).first()[0] if self.log else None
            self.batch = (last or 0) >> ROW_BITS
        self.batch += 1
        return self.batch

    def record(self, write: Any) -> None:
        if not applies_to_table(write.table, self.only, self.without):
            return
        before, after = write.before, write.after
        if before is None:
            before = after.limit(0)
        if after is None:
            after = before.limit(0)
        rows = diff_entries(before, after.select(*before.columns), write.key)
        noted = json.dumps(dict(self.metadata())) if self.metadata else None
        rows = with_ids(rows, self._next()).select("id", F.lit(write.table).alias("table_name"), "entity_id", "operation", "old_values", "new_values", F.lit(self.user()).cast("string").alias("changed_by"), F.lit(self.clock()).cast("timestamp_ntz").alias("changed_at"), F.lit(noted).cast("string").alias("metadata"))
        if self.sink:
            self.sink(rows)
        else:
            self.entries = rows if self.entries is None else self.entries.unionByName(rows)


def parsed(log: DataFrame) -> DataFrame:
    """The log with its images as maps; text that is no JSON gives null."""
    return log.withColumns({"old_values": F.from_json("old_values", FIELDS), "new_values": F.from_json("new_values", FIELDS)})


def history(log: DataFrame, table: str, entity: Any, limit: int | None = None, offset: int | None = None) -> DataFrame:
    rows = log.filter((F.col("table_name") == table) & (F.col("entity_id") == str(entity))).orderBy(F.desc("changed_at"), F.desc("id"))
    rows = rows.offset(offset) if offset else rows
    return parsed(rows.limit(limit) if limit is not None else rows)


def entry(log: DataFrame, id_: int) -> Any:
    return log.filter(F.col("id") == id_).first()


def table_logs(log: DataFrame, table: str, operation: str | None = None, user: str | None = None, start: Any = None, end: Any = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    rows = log.filter(F.col("table_name") == table)
    for column, value in (("operation", operation), ("changed_by", user)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    rows = rows.filter(F.col("changed_at") >= F.lit(start)) if start is not None else rows
    rows = rows.filter(F.col("changed_at") <= F.lit(end)) if end is not None else rows
    rows = paging.ordered(rows, [("changed_at", "desc"), ("id", "desc")])
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def user_changes(log: DataFrame, user: str, table: str | None = None) -> DataFrame:
    rows = log.filter(F.col("changed_by") == user)
    return rows.filter(F.col("table_name") == table) if table else rows


def state_at(log: DataFrame, moment: Any = None, keys: Sequence[str] = ("table_name", "entity_id")) -> DataFrame:
    """Each entity's state after all entries up to a moment: keys, state (map; null when deleted).

    An INSERT starts anew, an UPDATE merges, a DELETE clears. So of each field the last value after the
    entity's last INSERT or DELETE counts; both are maxima, which no task has to list an entity's entries for.
    """
    rows = log.filter(F.col("changed_at") <= F.lit(moment)) if moment is not None else log
    order, same = F.struct("changed_at", "id"), lambda a, b, on: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in on])
    resets = F.max(F.when(F.col("operation").isin("INSERT", "DELETE"), order))
    last = rows.groupBy(*keys).agg(resets.alias("_reset"))
    rows = rows.alias("e").join(last.alias("r"), same("e", "r", keys)).select("e.*", "_reset").filter(F.col("_reset").isNull() | (order >= F.col("_reset")))
    alive = rows.groupBy(*keys).agg(F.max(F.col("operation") != "DELETE").alias("_alive"))
    fields = rows.filter(F.col("operation") != "DELETE").select(*keys, order.alias("_order"), F.explode(F.from_json("new_values", FIELDS)).alias("_field", "_value"))
    fields = fields.groupBy(*keys, "_field").agg(F.max_by("_value", "_order").alias("_value"))
    # An entity has as many entries here as its table has columns.
    states = fields.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_field", "_value")))).alias("_state"))
    both = alive.alias("a").join(states.alias("s"), same("a", "s", keys), "left")
    return both.select(*[f"a.{k}" for k in keys], F.when(F.col("_alive"), F.coalesce("_state", F.create_map().cast(FIELDS))).alias("state"))


def by_nearness(log: DataFrame, moment: Any) -> DataFrame:
    """The log, entries nearest in time first; the earlier id of equals."""
    away = F.abs(F.unix_micros(F.col("changed_at").cast("timestamp")) - F.unix_micros(F.lit(moment).cast("timestamp")))
    return log.orderBy(away, "id")


def nearest(log: DataFrame, moment: Any) -> Any:
    return by_nearness(log, moment).first()


def find_entry(log: DataFrame, reference: str | int, parse: Callable[[str], Any] = datetime.fromisoformat) -> Any:
    """By id where the reference is a number, else by time."""
    text = str(reference).strip()
    return entry(log, int(text)) if text.isdigit() else nearest(log, parse(text))


def map_diff(old: Column, new: Column) -> dict[str, Column]:
    """added, removed, changed, unchanged keys of two maps; a null map has none."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(F.map_keys(old), empty), F.coalesce(F.map_keys(new), empty)
    both = F.array_intersect(a, b)
    same = lambda k: old[k].eqNullSafe(new[k])
    ordered = lambda c: F.array_sort(c)
    return {"added": ordered(F.array_except(b, a)), "removed": ordered(F.array_except(a, b)), "changed": ordered(F.filter(both, lambda k: ~same(k))), "unchanged": ordered(F.filter(both, same))}


def changed_fields(log: DataFrame) -> DataFrame:
    """The log with the names of the fields that each entry changed."""
    old, new = F.from_json("old_values", FIELDS), F.from_json("new_values", FIELDS)
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys(old), F.array().cast("array<string>")), F.coalesce(F.map_keys(new), F.array().cast("array<string>"))))
    return log.withColumn("fields", F.array_sort(F.filter(names, lambda k: ~old[k].eqNullSafe(new[k]))))


def restored(current: DataFrame, log_entry: Any, key: Sequence[str], undo_insert: bool = False) -> writes.Change:
    """Undoes an entry: a DELETE's row comes back, an UPDATE's old values do, and (if asked for) an INSERT's row goes."""
    spark = current.sparkSession
    if log_entry is None:
        raise NotFoundError("no such audit entry")
    where = entity_id(key) == log_entry["entity_id"]
    if log_entry["operation"] == "INSERT":
        if not undo_insert:
            raise AuditRestoreError("an INSERT has nothing to restore")
        return writes.delete(current, where)
    if log_entry["old_values"] is None:
        raise AuditMissingValuesError("the entry holds no old values")
    old = spark.createDataFrame([(log_entry["old_values"],)], "j string").select(F.from_json("j", current.schema).alias("r")).select("r.*")
    if log_entry["operation"] == "DELETE":
        return writes.insert(current, old)
    return writes.update_by_keys(current, old, key)
