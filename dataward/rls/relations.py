"""Access by relationship: a row is open if a path of joins leads from it to the user."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import context as auth
from ..errors import ContextMissingError, PolicySchemaError
from ..plugins.base import SECURITY, Plugin, QueryContext
from .policy import match


@dataclass(frozen=True)
class Step:
    """From the table before (the governed one, for the first step) to a table, on from_column = to_column."""

    to: str
    from_column: str = ""
    to_column: str = "id"
    from_: str = ""
    conditions: Mapping[str, Any] = field(default_factory=dict)
    how: str = "inner"

    @property
    def source_column(self) -> str:
        return self.from_column or f"{self.to}_id"


@dataclass(frozen=True)
class Path:
    name: str
    steps: tuple[Step, ...]

    def __post_init__(self) -> None:
        if not self.steps:
            raise PolicySchemaError(f"{self.name}: a path needs a step")
        for s in self.steps:
            if not s.to or s.how not in ("inner", "left", "right", "full"):
                raise PolicySchemaError(f"{self.name}: a step needs a table and a kind of join")
        for a, b in zip(self.steps, self.steps[1:], strict=False):
            if b.from_ and b.from_ != a.to:
                raise PolicySchemaError(f"{self.name}: {b.from_} does not follow {a.to}")


def path_keys(path: Path, tables: Mapping[str, DataFrame], end: Mapping[str, Any]) -> DataFrame:
    """The keys of the first step from which the path leads to its end, each once."""
    first = path.steps[0]
    at = tables[first.to].filter(match(first.conditions)) if first.conditions else tables[first.to]
    at = at.select(*[F.col(c).alias(f"s0_{c}") for c in at.columns])
    for i, step in enumerate(path.steps[1:], 1):
        # Conditions of later steps belong to the join: an outer one keeps its rows.
        to = tables[step.to].filter(match(step.conditions)) if step.conditions else tables[step.to]
        to = to.select(*[F.col(c).alias(f"s{i}_{c}") for c in to.columns])
        at = at.join(to, F.col(f"s{i - 1}_{step.source_column}") == F.col(f"s{i}_{step.to_column}"), step.how)
    last = len(path.steps) - 1
    wanted = {f"s{last}_{c}": v for c, v in end.items()}
    return at.filter(match(wanted)).select(F.col(f"s0_{first.to_column}").alias("_path_key")).distinct()


def related(main: DataFrame, path: Path, tables: Mapping[str, DataFrame], end: Mapping[str, Any], deny: bool = False) -> DataFrame:
    """Rows of main that the path connects to its end; with deny, the others, rows with a null key among them."""
    keys = path_keys(path, tables, end)
    return main.join(keys, main[path.steps[0].source_column] == keys["_path_key"], "left_anti" if deny else "left_semi")


def membership(name: str, *chain: tuple[str, str, str]) -> Path:
    """A path from (table, column before, column there) triples."""
    return Path(name, tuple(Step(t, a, b) for t, a, b in chain))


def organization_path() -> Path:
    return membership("organization", ("organizations", "organization_id", "id"), ("employees", "id", "organization_id"))


def shop_path() -> Path:
    return membership("shop", ("shops", "shop_id", "id"), ("organizations", "organization_id", "id"), ("employees", "id", "organization_id"))


def team_path() -> Path:
    return membership("team", ("teams", "team_id", "id"), ("team_members", "id", "team_id"))


@dataclass(frozen=True)
class RelationPolicy:
    path: Path
    end: Any
    deny: bool = False


def allow_relation(path: Path, end: Any) -> RelationPolicy:
    return RelationPolicy(path, end)


def deny_relation(path: Path, end: Any) -> RelationPolicy:
    return RelationPolicy(path, end, True)


class RelationSecurity(Plugin):
    """All relation policies of a table must hold; only system contexts are not filtered.

    Without a context a table with policies can't be read or, with require_context off, shows nothing.
    """

    name, priority = "rebac", SECURITY - 1

    def __init__(self, policies: Mapping[str, Sequence[RelationPolicy]], require_context: bool = True):
        self.policies, self.require_context = policies, require_context

    def intercept(self, df: DataFrame, query: QueryContext, session: Any) -> DataFrame:
        context = auth.current()
        if not self.policies.get(query.table) or (context is not None and context.is_system):
            return df
        if context is None:
            if self.require_context:
                raise ContextMissingError(f"{query.table}: no auth context")
            return df.filter(F.lit(False))

        class Tables(dict):
            def __missing__(self, name: str) -> DataFrame:
                return session.raw(name)

        def one(rows: DataFrame, p: RelationPolicy) -> DataFrame:
            return related(rows, p.path, Tables(), p.end(context) if callable(p.end) else p.end, p.deny)

        return reduce(one, self.policies.get(query.table, ()), df)


__all__ = ["Path", "RelationPolicy", "RelationSecurity", "Step", "allow_relation", "deny_relation", "membership", "organization_path", "path_keys", "related", "shop_path", "team_path"]
