"""The plugin protocol, and the order in which plugins apply."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import PluginError

# Priorities; higher ones apply first.
SECURITY, FILTER, TRANSFORM, AUDIT, DEFAULT, DEBUG = 1000, 500, 100, 50, 0, -100


@dataclass(frozen=True)
class QueryContext:
    operation: str
    table: str
    schema: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


class Plugin:
    name = "plugin"
    version = "1.0"
    priority = DEFAULT
    dependencies: Sequence[str] = ()
    conflicts_with: Sequence[str] = ()

    def on_init(self, session: Any) -> None:
        """Runs once, when the session is built."""

    def on_destroy(self, session: Any) -> None:
        """Runs once, in reverse order."""

    def intercept(self, df: DataFrame, context: QueryContext, session: Any) -> DataFrame:
        """The table as this plugin lets it be seen."""
        return df

    def extend(self, repository: Any) -> Any:
        """The repository with what this plugin adds."""
        return repository

    def guard(self, write: Any) -> None:
        """Raises if a write is not allowed."""

    def stamp(self, write: Any) -> None:
        """Fills in values of a write."""

    def record(self, write: Any) -> None:
        """Notes a write that took place."""


def validate_plugins(plugins: Sequence[Plugin]) -> None:
    names = [p.name for p in plugins]
    if twice := {n for n in names if names.count(n) > 1}:
        raise PluginError(f"plugin registered twice: {', '.join(sorted(twice))}")
    for p in plugins:
        if missing := [d for d in p.dependencies if d not in names]:
            raise PluginError(f"{p.name} needs {', '.join(missing)}")
        if against := [c for c in p.conflicts_with if c in names]:
            raise PluginError(f"{p.name} does not go with {', '.join(against)}")
    if path := find_cycle(plugins):
        raise PluginError(f"plugins depend on each other in a circle: {' -> '.join(path)}")


def find_cycle(plugins: Sequence[Plugin]) -> list[str]:
    """A circle of dependencies, its first name again at its end; empty if there is none."""
    needs = {p.name: sorted(p.dependencies) for p in plugins}
    done: set[str] = set()
    for start in sorted(needs):
        path, stack = [], [(start, iter(needs.get(start, ())))] if start not in done else []
        if stack:
            path.append(start)
        while stack:
            name, rest = stack[-1]
            if (following := next(rest, None)) is None:
                done.add(name)
                stack.pop()
                path.pop()
            elif following in path:
                return [*path[path.index(following) :], following]
            elif following not in done:
                path.append(following)
                stack.append((following, iter(needs.get(following, ()))))
    return []


def resolve_order(plugins: Sequence[Plugin]) -> list[Plugin]:
    """Dependencies come first; among the free ones the higher priority does, then the name."""
    validate_plugins(plugins)
    by_name = {p.name: p for p in plugins}
    waiting = {p.name: len(set(p.dependencies)) for p in plugins}
    ready = [(-p.priority, p.name) for p in plugins if not waiting[p.name]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, name = heapq.heappop(ready)
        out.append(by_name[name])
        for p in plugins:
            if name in p.dependencies:
                waiting[p.name] -= 1
                if not waiting[p.name]:
                    heapq.heappush(ready, (-p.priority, p.name))
    return out
