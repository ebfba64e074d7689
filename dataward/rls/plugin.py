"""The plugin that filters reads and guards writes by policy."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import context as auth
from ..errors import ContextMissingError, PolicyViolationError
from ..operators import writes
from ..plugins.base import SECURITY, Plugin, QueryContext
from .fields import FieldAccess, check_write, mask_frame
from .policy import Registry, TablePolicies


class RowSecurity(Plugin):
    name, priority = "rls", SECURITY

    def __init__(self, schema: dict[str, TablePolicies], require_context: bool = True, allow_unfiltered: bool = False, bypass_roles: Collection[str] = (), exclude: Collection[str] = (), on_decision: Callable[[dict[str, Any]], None] | None = None):
        self.registry = Registry().load(schema)
        self.require_context, self.allow_unfiltered, self.bypass_roles, self.exclude, self.on_decision = require_context, allow_unfiltered, bypass_roles, exclude, on_decision

    def _decide(self, table: str, operation: str, decision: str, context: auth.AuthContext | None) -> None:
        if self.on_decision:
            self.on_decision({"table": table, "operation": operation, "decision": decision, "user_id": None if context is None else str(context.user_id)})

    def rules(self, table: str) -> TablePolicies | None:
        return None if table in self.exclude else self.registry.tables.get(table)

    def open_to(self, context: auth.AuthContext) -> bool:
        return context.is_system or context.has_role(*self.bypass_roles)

    def intercept(self, df: DataFrame, query: QueryContext, session: Any) -> DataFrame:
        rules = self.rules(query.table)
        if rules is None or query.metadata.get("skip_rls"):
            return df
        context = auth.current()
        if context is None:
            if self.require_context:
                raise ContextMissingError(f"{query.table}: no auth context")
            return df if self.allow_unfiltered else df.filter(F.lit(False))
        if self.open_to(context) or rules.open_to(context):
            return df
        self._decide(query.table, "read", "filter", context)
        return df.filter(rules.visible(context))

    def guard(self, write: Any) -> None:
        """Every path of writing comes by here; without a context nothing is written."""
        rules = self.rules(write.table)
        if rules is None or write.flags.get("skip_rls"):
            return
        context = auth.current()
        if context is None:
            if self.allow_unfiltered and not self.require_context:
                return
            raise ContextMissingError(f"{write.table}: no auth context")
        if self.open_to(context) or rules.open_to(context):
            return
        checks = {"create": [("create", write.after)], "delete": [("delete", write.before)]}.get(write.operation)
        if checks is None:  # an update must be allowed on the row as it was, and on the row as it will be
            checks = [("update", write.before), ("update", write.after)]
            if write.operation == "upsert":
                known = write.before.select(*write.key)
                checks = [("update", write.before), ("update", write.after.join(known, list(write.key), "left_semi")), ("create", write.after.join(known, list(write.key), "left_anti"))]
        for operation, rows in checks:
            if not rows.filter(~rules.permitted(operation, context)).limit(1).isEmpty():
                self._decide(write.table, operation, "deny", context)
                raise PolicyViolationError(f"{write.table}: {operation} is not allowed")
        self._decide(write.table, write.operation, "allow", context)

    def extend(self, repository: Any) -> Any:
        repository.security = SecurityMethods(repository, self)
        return repository


class SecurityMethods:
    def __init__(self, repository: Any, plugin: RowSecurity):
        self.repository, self.plugin = repository, plugin

    def without(self, work: Callable[[Any], Any]) -> Any:
        with auth.as_system():
            return work(self.repository)

    def permitted(self, operation: str, rows: DataFrame) -> DataFrame:
        """The rows that the user may touch this way; reading has no default denial."""
        rules = self.plugin.rules(self.repository.name)
        if rules is None:
            return rows
        context = auth.required()
        return rows.filter(rules.visible(context) if operation == "read" else rules.permitted(operation, context))

    def can_access(self, operation: str, key: Any) -> bool:
        row = self.repository.raw.filter(self.repository._key(key))
        return not self.permitted(operation, row).isEmpty()

    def _check(self, operation: str, *versions: DataFrame) -> None:
        rules = self.plugin.rules(self.repository.name)
        if rules is None or self.plugin.open_to(auth.required()):
            return
        for rows in versions:
            if not rows.filter(~rules.permitted(operation, auth.required())).limit(1).isEmpty():
                raise PolicyViolationError(f"{self.repository.name}: {operation} is not allowed")

    def check_create(self, rows: Sequence[Mapping[str, Any]]) -> None:
        """Raises if one of the new rows may not be created; nothing is written."""
        self._check("create", writes.rows_of(self.repository.raw, rows))

    def check_update(self, key: Any, patch: Mapping[str, Any]) -> None:
        row = self.repository.raw.filter(self.repository._key(key))
        self._check("update", row, writes.update(row, F.lit(True), patch).affected)

    def check_delete(self, key: Any) -> None:
        self._check("delete", self.repository.raw.filter(self.repository._key(key)))

    def check_read(self, key: Any) -> bool:
        return self.can_access("read", key)

    def can_mutate(self, operation: str, key: Any = None, values: Mapping[str, Any] | None = None) -> bool:
        """Whether check_create, check_update or check_delete would pass."""
        try:
            if operation == "create":
                self.check_create([values or {}])
            elif operation == "update":
                self.check_update(key, values or {})
            else:
                self.check_delete(key)
        except PolicyViolationError:
            return False
        return True


class FieldSecurity(Plugin):
    """Reads show what a context may read of each column; writes that set a column it may not write are refused."""

    name, priority = "fields", SECURITY - 2

    def __init__(self, access: Mapping[str, FieldAccess], skip_for: Collection[str] = (), require_context: bool = True):
        self.access, self.skip_for, self.require_context = access, skip_for, require_context

    def _context(self, table: str) -> auth.AuthContext | None:
        """The context to check against; None where nothing is checked."""
        context = auth.current()
        if table not in self.access:
            return None
        if context is None:
            if self.require_context:
                raise ContextMissingError(f"{table}: no auth context")
            return None
        return None if context.is_system or context.has_role(*self.skip_for) else context

    def intercept(self, df: DataFrame, query: QueryContext, session: Any) -> DataFrame:
        context = self._context(query.table)
        return mask_frame(df, self.access[query.table], context) if context else df

    def guard(self, write: Any) -> None:
        context = self._context(write.table)
        if context is None or write.operation == "delete":
            return
        known = write.before if write.before is not None else write.after.limit(0)
        new = write.after.join(known.select(*write.key), list(write.key), "left_anti")
        given = [c for c in write.given if write.operation == "create" or c not in write.key]
        for rows in (known, new):
            check_write(rows, dict.fromkeys(given), self.access[write.table], context)


def verdicts(rows: DataFrame, rules: TablePolicies, operation: str, context: auth.AuthContext, name: str = "verdict") -> DataFrame:
    """rows with whether each may be touched: the dry run of a policy."""
    return rows.withColumn(name, rules.visible(context) if operation == "read" else rules.permitted(operation, context))


def push_context(spark: SparkSession, context: auth.AuthContext, prefix: str = "rls_") -> list[str]:
    """Temporary SQL functions with what the context says, for conditions in text queries; their names."""
    text = lambda v: "CAST(NULL AS STRING)" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    member = lambda values: f"array_contains(CAST(array({', '.join(map(text, values))}) AS ARRAY<STRING>), name)"
    bodies = {
        "user_id()": ("STRING", text(context.user_id)),
        "tenant_id()": ("STRING", text(context.tenant_id)),
        "is_system()": ("BOOLEAN", str(context.is_system).upper()),
        "has_role(name STRING)": ("BOOLEAN", member(context.roles)),
        "has_permission(name STRING)": ("BOOLEAN", member(context.permissions)),
        "in_organization(name STRING)": ("BOOLEAN", member(context.organization_ids)),
    }
    for signature, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS {kind} RETURN {body}")
    return [f"{prefix}{s.partition('(')[0]}" for s in bodies]


def governed_view(df: DataFrame, rules: TablePolicies, context: auth.AuthContext, name: str) -> None:
    """A temporary view for SQL that holds only what the context may see."""
    df.filter(rules.visible(context)).createOrReplaceTempView(name)
