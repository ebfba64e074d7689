"""Who is asking: the auth context of the present task or thread."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field, replace
from typing import Any

from .errors import BadRequestError, ContextMissingError


@dataclass(frozen=True)
class AuthContext:
    user_id: Any
    roles: tuple[str, ...]
    tenant_id: Any = None
    organization_ids: tuple[Any, ...] = ()
    permissions: tuple[str, ...] = ()
    attributes: dict[str, Any] = field(default_factory=dict)
    is_system: bool = False

    def __post_init__(self) -> None:
        if self.user_id is None:
            raise BadRequestError("a context needs a user id")
        if not isinstance(self.roles, (tuple, list)):
            raise BadRequestError("a context needs a list of roles")
        object.__setattr__(self, "roles", tuple(self.roles))

    def has_role(self, *names: str) -> bool:
        return any(n in self.roles for n in names)

    def has_permission(self, name: str) -> bool:
        return name in self.permissions


_current: ContextVar[AuthContext | None] = ContextVar("auth", default=None)


def current() -> AuthContext | None:
    return _current.get()


def required() -> AuthContext:
    if (found := current()) is None:
        raise ContextMissingError("no auth context")
    return found


@contextmanager
def run_as(context: AuthContext) -> Iterator[AuthContext]:
    token = _current.set(context)
    try:
        yield context
    finally:
        _current.reset(token)


@contextmanager
def as_system() -> Iterator[AuthContext]:
    """The present user, or one named system, with all rows open."""
    base = current() or AuthContext("system", ())
    with run_as(replace(base, is_system=True)) as context:
        yield context
