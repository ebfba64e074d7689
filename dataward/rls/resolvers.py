"""What a context needs to know about its user, resolved once on the driver and cached for a while."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from contextvars import copy_context
from dataclasses import dataclass, replace
from graphlib import CycleError, TopologicalSorter
from typing import Any

from ..context import AuthContext
from ..errors import PolicySchemaError


@dataclass(frozen=True)
class Resolver:
    name: str
    resolve: Callable[[AuthContext, dict[str, Any]], dict[str, Any]]
    needs: tuple[str, ...] = ()
    required: bool = True
    ttl: float = 300.0
    timeout: float = 5.0
    priority: int = 0


class Resolvers:
    """Resolvers that don't need each other run side by side; of equal names, what was found first stays."""

    def __init__(self, resolvers: Sequence[Resolver]):
        self.resolvers = {r.name: r for r in resolvers}
        self.cache: dict[tuple[str, str], tuple[float, dict[str, Any]]] = {}
        if missing := {n for r in resolvers for n in r.needs} - set(self.resolvers):
            raise PolicySchemaError(f"unknown resolvers: {', '.join(sorted(missing))}")
        try:
            sorter = TopologicalSorter({r.name: r.needs for r in resolvers})
            sorter.prepare()
        except CycleError as e:
            raise PolicySchemaError(f"resolvers need each other: {e.args[1]}") from e
        self.levels: list[list[str]] = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=lambda n: (-self.resolvers[n].priority, n))
            self.levels.append(ready)
            sorter.done(*ready)

    def _one(self, name: str, context: AuthContext, found: dict[str, Any]) -> dict[str, Any]:
        key, now = (name, str(context.user_id)), time.monotonic()
        if key in self.cache and self.cache[key][0] > now:
            return self.cache[key][1]
        value = self.resolvers[name].resolve(context, found)
        self.cache[key] = (now + self.resolvers[name].ttl, value)
        return value

    def resolve(self, context: AuthContext) -> AuthContext:
        found: dict[str, Any] = {}
        for level in self.levels:
            pool = ThreadPoolExecutor(max(1, len(level)))
            jobs = {n: pool.submit(copy_context().run, self._one, n, context, dict(found)) for n in level}
            for name, job in jobs.items():
                wait([job], self.resolvers[name].timeout)
                try:
                    value = job.result(timeout=0)
                except Exception as e:
                    if self.resolvers[name].required:
                        pool.shutdown(wait=False, cancel_futures=True)
                        raise RuntimeError(f"resolver {name} failed") from e
                    continue
                found = {**value, **found}
            pool.shutdown(wait=False)
        return replace(context, attributes={**found, **context.attributes})

    def invalidate(self, user_id: Any = None) -> None:
        self.cache = {} if user_id is None else {k: v for k, v in self.cache.items() if k[1] != str(user_id)}
