"""Helpers for tests: factories, generated rows, seeds and assertions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.where import compile_where
from .plugins.base import Plugin
from .sources.store import Store


class Factory:
    """Rows from defaults; callables among them get the row's number."""

    def __init__(self, **defaults: Any):
        self.defaults, self.n = defaults, 0

    def build(self, **given: Any) -> dict[str, Any]:
        self.n += 1
        return {k: v(self.n) if callable(v) else v for k, v in {**self.defaults, **given}.items()}

    def build_many(self, count: int, **given: Any) -> list[dict[str, Any]]:
        return [self.build(**given) for _ in range(count)]


def generated(spark: SparkSession, schema: T.StructType, rows: int, seed: int = 0, parents: Mapping[str, int] | None = None) -> DataFrame:
    """Rows with plausible values by type and name, the same for the same seed; parents bounds foreign keys."""

    def value(i: int, f: T.StructField) -> Column:
        draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed * 1009 + i)), F.lit(1_000_000_007))
        if parents and f.name in parents:
            return (F.pmod(draw, F.lit(parents[f.name])) + 1).cast(f.dataType)
        if f.name == "id":
            return (F.col("id") + 1).cast(f.dataType)
        if isinstance(f.dataType, T.BooleanType):
            return draw % 2 == 0
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.timestamp_seconds(draw + 700_000_000).cast(f.dataType)
        if isinstance(f.dataType, T.NumericType):
            return (F.pmod(draw, F.lit(100_000)) / 100).cast(f.dataType)
        if "email" in f.name:
            return F.concat(F.lit("user"), (F.col("id") + 1).cast("string"), F.lit("@example.com"))
        return F.concat(F.lit(f"{f.name} "), draw.cast("string"))

    return spark.range(rows).select(*[value(i, f).alias(f.name) for i, f in enumerate(schema.fields)])


def random_row(df: DataFrame, seed: int = 0) -> DataFrame:
    """One row by a hash of its values and the seed, so the same each time."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed))).limit(1)


def snapshot(df: DataFrame) -> list[tuple[Any, ...]]:
    """A small table's rows in order of their text."""
    return sorted(map(tuple, df.collect()), key=repr)


def assert_row(df: DataFrame, **where: Any) -> None:
    assert not df.filter(compile_where(where)).limit(1).isEmpty(), f"no row with {where}"


def assert_no_row(df: DataFrame, **where: Any) -> None:
    assert df.filter(compile_where(where)).limit(1).isEmpty(), f"a row with {where}"


def assert_count(df: DataFrame, n: int, **where: Any) -> None:
    found = df.filter(compile_where(where)).count()
    assert found == n, f"{found} rows, not {n}"


def seed(store: Store, *seeds: Callable[[Store], Mapping[str, DataFrame]], together: bool = True) -> None:
    """Seed functions in one commit, or each in its own."""
    if together:
        store.commit({k: df for s in seeds for k, df in s(store).items()})
    else:
        for s in seeds:
            store.commit(dict(s(store)))


def clean(store: Store, names: Sequence[str] | None = None, strategy: str = "truncate") -> None:
    names = store.tables() if names is None else names
    if strategy == "truncate":
        store.truncate(*names)
    elif strategy == "drop":
        store.drop(*names)


class SpyPlugin(Plugin):
    """Notes what it is asked."""

    def __init__(self, name: str = "spy", priority: int = 0, dependencies: Sequence[str] = (), conflicts_with: Sequence[str] = ()):
        self.name, self.priority, self.dependencies, self.conflicts_with, self.calls = name, priority, dependencies, conflicts_with, []

    def intercept(self, df: DataFrame, context: Any, session: Any) -> DataFrame:
        self.calls.append((context.operation, context.table))
        return df

    def guard(self, write: Any) -> None:
        self.calls.append((f"guard:{write.operation}", write.table))

    def record(self, write: Any) -> None:
        self.calls.append((f"record:{write.operation}", write.table))

    def on_destroy(self, session: Any) -> None:
        self.calls.append(("destroy", self.name))
