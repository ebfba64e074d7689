"""Policies as data. Conditions are functions of the auth context that return Columns, so Catalyst sees
them; nothing is called per row."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..context import AuthContext
from ..errors import PolicySchemaError
from ..operators.where import UNDEFINED

OPERATIONS = ("read", "create", "update", "delete")
KINDS = ("allow", "deny", "filter", "validate")
#: A condition: always, a Column, or a function of the context giving either or a mapping of columns to values.
Condition = Any


@dataclass(frozen=True)
class Policy:
    kind: str
    operations: tuple[str, ...]
    condition: Condition = None
    name: str = ""
    priority: int = 0
    active: Callable[[AuthContext], bool] | None = None

    def covers(self, operation: str) -> bool:
        return operation in self.operations

    def holds_for(self, context: AuthContext) -> bool:
        return self.active is None or self.active(context)

    def column(self, context: AuthContext) -> Column:
        value = self.condition(context) if callable(self.condition) and not isinstance(self.condition, Column) else self.condition
        if value is None:
            return F.lit(True)
        if isinstance(value, Mapping):
            return match(value)
        return F.coalesce(value if isinstance(value, Column) else F.lit(bool(value)), F.lit(False))


def match(values: Mapping[str, Any]) -> Column:
    """Columns equal to values: None means null, a list means one of it; what is undefined matches nothing."""

    def one(column: str, value: Any) -> Column:
        if value is UNDEFINED:
            return F.lit(False)
        if value is None:
            return F.col(column).isNull()
        if isinstance(value, (list, tuple, set, frozenset)):
            return F.col(column).isin(list(value)) if value else F.lit(False)
        return F.col(column) == F.lit(value)

    return reduce(and_, [one(c, v) for c, v in values.items()], F.lit(True))


def _operations(operations: str | Sequence[str]) -> tuple[str, ...]:
    named = (operations,) if isinstance(operations, str) else tuple(operations)
    named = OPERATIONS if "all" in named else named
    if unknown := set(named) - set(OPERATIONS):
        raise PolicySchemaError(f"unknown operations: {', '.join(sorted(unknown))}")
    return named


def allow(operations: str | Sequence[str], condition: Condition = None, name: str = "", priority: int = 0) -> Policy:
    return Policy("allow", _operations(operations), condition, name, priority)


def deny(operations: str | Sequence[str], condition: Condition = None, name: str = "", priority: int = 100) -> Policy:
    """Without a condition, always."""
    return Policy("deny", _operations(operations), condition, name, priority)


def filter_(operations: str | Sequence[str], condition: Condition, name: str = "", priority: int = 0) -> Policy:
    return Policy("filter", _operations(operations), condition, name, priority)


def validate(operations: str | Sequence[str], condition: Condition, name: str = "", priority: int = 0) -> Policy:
    named = ("create", "update") if operations == "all" else _operations(operations)
    return Policy("validate", named, condition, name, priority)


def when(policy: Policy, active: Callable[[AuthContext], bool]) -> Policy:
    """The policy, in force only when `active` says so as the plan is built."""
    before = policy.active
    return replace(policy, active=lambda c: active(c) and (before is None or before(c)))


def when_environment(policy: Policy, names: Sequence[str], variable: str = "ENVIRONMENT") -> Policy:
    return when(policy, lambda c: c.attributes.get("environment", os.environ.get(variable)) in names)


def when_feature(policy: Policy, feature: str) -> Policy:
    return when(policy, lambda c: feature in c.attributes.get("features", ()))


def when_hours(policy: Policy, start: int, end: int, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> Policy:
    """From start to before end, past midnight where end comes first."""
    inside = lambda h: start <= h < end if start <= end else h >= start or h < end
    return when(policy, lambda c: inside(now().hour))


@dataclass(frozen=True)
class TablePolicies:
    policies: tuple[Policy, ...]
    default_deny: bool = True
    skip_for: tuple[str, ...] = ()

    def of(self, kind: str, operation: str, context: AuthContext) -> list[Policy]:
        """The kind's policies in force; filters as registered, others by falling priority."""
        found = [p for p in self.policies if p.kind == kind and p.covers(operation) and p.holds_for(context)]
        return found if kind == "filter" else sorted(found, key=lambda p: -p.priority)

    def open_to(self, context: AuthContext) -> bool:
        return context.is_system or context.has_role(*self.skip_for)

    def visible(self, context: AuthContext) -> Column:
        """What reads may see: all filters hold, and no deny of reading does."""
        if self.open_to(context):
            return F.lit(True)
        seen = [p.column(context) for p in self.of("filter", "read", context)] + [~p.column(context) for p in self.of("deny", "read", context)]
        return reduce(and_, seen, F.lit(True))

    def permitted(self, operation: str, context: AuthContext) -> Column:
        """Which rows a write may touch: no deny, all validations, and some allow (unless not denied by default)."""
        if self.open_to(context):
            return F.lit(True)
        denied = reduce(or_, [p.column(context) for p in self.of("deny", operation, context)], F.lit(False))
        valid = reduce(and_, [p.column(context) for p in self.of("validate", operation, context)], F.lit(True))
        allows = [p.column(context) for p in self.of("allow", operation, context)]
        allowed = reduce(or_, allows) if allows else F.lit(not self.default_deny)
        return ~denied & valid & allowed


@dataclass
class Registry:
    tables: dict[str, TablePolicies] = field(default_factory=dict)

    def register(self, table: str, policies: TablePolicies) -> None:
        check_schema({table: policies})
        named = tuple(replace(p, name=p.name or f"{table}_{p.kind}_{i}") for i, p in enumerate(policies.policies))
        self.tables[table] = replace(policies, policies=named)

    def load(self, schema: Mapping[str, TablePolicies]) -> Registry:
        for table, policies in schema.items():
            self.register(table, policies)
        return self

    def clear(self) -> None:
        self.tables.clear()


def check_schema(schema: Mapping[str, TablePolicies]) -> None:
    for table, rules in schema.items():
        for p in rules.policies:
            if p.kind not in KINDS:
                raise PolicySchemaError(f"{table}: unknown kind {p.kind}")
            if p.kind in ("filter", "validate") and p.condition is None:
                raise PolicySchemaError(f"{table}: {p.kind} needs a condition")
            if p.kind == "filter" and p.operations != ("read",):
                raise PolicySchemaError(f"{table}: filters apply to reading only")
            if p.kind == "validate" and set(p.operations) - {"create", "update"}:
                raise PolicySchemaError(f"{table}: validation applies to create and update only")
        named = [p.name for p in rules.policies if p.name]
        if len(named) != len(set(named)):
            raise PolicySchemaError(f"{table}: policy names repeat")


def merge(*schemas: Mapping[str, TablePolicies]) -> dict[str, TablePolicies]:
    out: dict[str, TablePolicies] = {}
    for schema in schemas:
        for table, rules in schema.items():
            before = out.get(table)
            out[table] = rules if before is None else TablePolicies(before.policies + rules.policies, before.default_deny and rules.default_deny, tuple(dict.fromkeys(before.skip_for + rules.skip_for)))
    return out


def extend(base: TablePolicies, *more: Policy) -> TablePolicies:
    return replace(base, policies=base.policies + more)


def override(base: TablePolicies, **named: Policy) -> TablePolicies:
    """Policies of these names replaced."""
    return replace(base, policies=tuple(replace(named[p.name], name=p.name) if p.name in named else p for p in base.policies))


# Reusable policies


def tenant_isolation(column: str = "tenant_id", validate_writes: bool = True) -> tuple[Policy, ...]:
    """Rows of the user's tenant only; a user without a tenant sees nothing."""
    mine = lambda c: {column: UNDEFINED if c.tenant_id is None else c.tenant_id}
    return (filter_("read", mine, "tenant"), *([validate("all", mine, "tenant_write")] if validate_writes else []))


def ownership(column: str = "owner_id", operations: Sequence[str] = ("read", "update", "delete")) -> tuple[Policy, ...]:
    return (allow(operations, lambda c: {column: c.user_id}, "owner"),)


def soft_deleted(column: str = "deleted_at", forbid_delete: bool = True) -> tuple[Policy, ...]:
    return (filter_("read", lambda c: {column: None}, "not_deleted"), *([deny("delete", name="no_hard_delete")] if forbid_delete else []))


def status_access(column: str, public: Sequence[str], editable: Sequence[str] = (), deletable: Sequence[str] = ()) -> tuple[Policy, ...]:
    rules = [filter_("read", lambda c: {column: list(public)}, "status")] if public else []
    rules += [deny("update", lambda c: ~F.col(column).isin(list(editable)), "status_edit")] if editable else []
    rules += [deny("delete", lambda c: ~F.col(column).isin(list(deletable)), "status_delete")] if deletable else []
    return tuple(rules)


def admin_all(*roles: str) -> tuple[Policy, ...]:
    return (allow("all", lambda c: c.has_role(*(roles or ("admin",))), "admin", 50),)
