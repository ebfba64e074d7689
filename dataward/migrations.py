"""Ordered, recorded changes of a store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from .errors import MigrationError
from .sources.store import Store

TABLE, SCHEMA = "migrations", "name string, batch int, executed_at timestamp_ntz"


@dataclass(frozen=True)
class Migration:
    name: str
    up: Callable[[Store], Any]
    down: Callable[[Store], Any] | None = None
    description: str = ""


class Runner:
    """Migrations go up in order of name, and down in reverse, last batch first."""

    def __init__(self, store: Store, migrations: Sequence[Migration], clock: Callable[[], datetime] | None = None):
        names = [m.name for m in migrations]
        if len(set(names)) != len(names):
            raise MigrationError("migration names repeat")
        self.store, self.migrations = store, sorted(migrations, key=lambda m: m.name)
        self.clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def executed(self) -> dict[str, int]:
        if not self.store.exists(TABLE):
            return {}
        return {r["name"]: r["batch"] for r in self.store.read(TABLE).collect()}

    def _record(self, rows: dict[str, int]) -> None:
        known = {r["name"]: r["executed_at"] for r in self.store.read(TABLE).collect()} if self.store.exists(TABLE) else {}
        now = self.clock()
        self.store.commit({TABLE: self.store.spark.createDataFrame([(n, b, known.get(n, now)) for n, b in rows.items()], SCHEMA)})

    def status(self) -> list[tuple[str, bool]]:
        done = self.executed()
        return [(m.name, m.name in done) for m in self.migrations]

    def locked_up(self, **options: Any) -> list[str]:
        """up(), while no other runner of the store may run."""
        with self.store.lock("_migrations.lock"):
            return self.up(**options)

    def up(self, to: str | None = None, dry_run: bool = False, stop_on_error: bool = True) -> list[str]:
        done = self.executed()
        batch = max(done.values(), default=0) + 1
        if to is not None and to not in {m.name for m in self.migrations}:
            raise MigrationError(f"no migration {to}")
        ran = []
        for m in self.migrations:
            if m.name not in done:
                if not dry_run:
                    try:
                        m.up(self.store)
                    except Exception as e:
                        if stop_on_error:
                            raise MigrationError(f"{m.name} failed after {ran}") from e
                        continue
                    done[m.name] = batch
                    self._record(done)
                ran.append(m.name)
            if m.name == to:
                break
        return ran

    def _down(self, chosen: Sequence[str], dry_run: bool) -> list[str]:
        done, back = self.executed(), []
        for m in reversed(self.migrations):
            if m.name in chosen:
                if m.down is None:
                    raise MigrationError(f"{m.name} can't be undone")
                if not dry_run:
                    m.down(self.store)
                    done.pop(m.name)
                    self._record(done)
                back.append(m.name)
        return back

    def down(self, steps: int = 1, dry_run: bool = False) -> list[str]:
        return self._down([m.name for m in self.migrations if m.name in self.executed()][-steps:] if steps else [], dry_run)

    def rollback(self, dry_run: bool = False) -> list[str]:
        """The last batch."""
        done = self.executed()
        return self._down([n for n, b in done.items() if b == max(done.values())], dry_run)

    def reset(self, dry_run: bool = False) -> list[str]:
        return self._down(list(self.executed()), dry_run)
