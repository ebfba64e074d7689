"""Composition of query functions: each takes a session or transaction and gives a DataFrame, or any value."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce, wraps
from typing import Any

from pyspark.sql import DataFrame

from ..errors import TransactionError
from ..session import Session
from .transaction import Transaction

Query = Callable[..., Any]


def session_of(context: Session | Transaction) -> Session:
    return context.session if isinstance(context, Transaction) else context


def query(fn: Query) -> Query:
    """fn gets a session, whatever it is called with."""

    @wraps(fn)
    def run(context: Session | Transaction, *args: Any, **more: Any) -> Any:
        return fn(session_of(context), *args, **more)

    return run


def transactional(fn: Query) -> Query:
    """fn runs inside a transaction only."""

    @wraps(fn)
    def run(context: Session | Transaction, *args: Any, **more: Any) -> Any:
        if not isinstance(context, Transaction) or not context.active:
            raise TransactionError(f"{fn.__name__} needs a transaction")
        return fn(context, *args, **more)

    return run


def compose(first: Query, second: Query) -> Query:
    """second gets the context and what first gave."""
    return lambda context, *args: second(context, first(context, *args))


def chain(first: Query, *steps: Query) -> Query:
    return reduce(compose, steps, first)


def parallel(**queries: Query) -> Query:
    """A mapping of results. Actions inside run side by side, each as the caller's user; DataFrames stay lazy."""

    def run(context: Session | Transaction, *args: Any) -> dict[str, Any]:
        with ThreadPoolExecutor(max(1, len(queries))) as pool:
            jobs = {k: pool.submit(copy_context().run, q, context, *args) for k, q in queries.items()}
            return {k: j.result() for k, j in jobs.items()}

    return run


def conditional(test: Callable[..., bool], then: Query, otherwise: Query | None = None) -> Query:
    def run(context: Session | Transaction, *args: Any) -> Any:
        chosen = then if test(context, *args) else otherwise
        return chosen(context, *args) if chosen else None

    return run


def map_result(fn: Query, change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda context, *args: change(fn(context, *args))
