"""Sessions: tables opened through an ordered fold of plugins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import BadRequestError, NotFoundError, PluginError
from .plugins.base import Plugin, QueryContext, resolve_order


@dataclass(frozen=True)
class TableSpec:
    """A table: its name, its key columns, and how to read it."""

    name: str
    source: str | Callable[[SparkSession], DataFrame]
    key: tuple[str, ...] = ("id",)
    required: tuple[str, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.source) if isinstance(self.source, str) else self.source(spark)


class Session:
    """Every table that it opens is governed; raw() is the one way around."""

    def __init__(self, spark: SparkSession, tables: Sequence[TableSpec] = (), plugins: Sequence[Plugin] = (), schema: str | None = None, overlay: dict[str, DataFrame] | None = None):
        self.spark, self.schema = spark, schema
        self.tables = {t.name: t for t in tables}
        self.plugins = resolve_order(plugins)
        self.overlay = overlay if overlay is not None else {}

    @classmethod
    def build(cls, spark: SparkSession, tables: Sequence[TableSpec] = (), plugins: Sequence[Plugin] = (), schema: str | None = None) -> Session:
        session = cls(spark, tables, plugins, schema)
        for p in session.plugins:
            p.on_init(session)
        return session

    def plugin(self, name: str) -> Plugin | None:
        return next((p for p in self.plugins if p.name == name), None)

    def spec(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise NotFoundError(f"no table {name}")
        return self.tables[name]

    def raw(self, name: str) -> DataFrame:
        return self.overlay[name] if name in self.overlay else self.spec(name).read(self.spark)

    def table(self, name: str, operation: str = "select", **metadata: Any) -> DataFrame:
        context = QueryContext(operation, name, self.schema, metadata)

        def through(df: DataFrame, p: Plugin) -> DataFrame:
            try:
                return p.intercept(df, context, self)
            except Exception as e:
                e.add_note(f"raised by plugin {p.name} for {operation} on {name}")
                raise

        return reduce(through, self.plugins, self.raw(name))

    def with_schema(self, schema: str) -> Session:
        return Session(self.spark, list(self.tables.values()), self.plugins, schema, self.overlay)

    def with_plugins(self, *plugins: Plugin) -> Session:
        return Session.build(self.spark, list(self.tables.values()), [*self.plugins, *plugins], self.schema)

    def repository(self, name: str) -> Any:
        from .plans.repository import Repository

        return reduce(lambda r, p: p.extend(r), self.plugins, Repository(self, self.spec(name)))

    def destroy(self) -> None:
        """Plugins end in reverse order; what goes wrong is raised once all have."""
        wrong = []
        for p in reversed(self.plugins):
            try:
                p.on_destroy(self)
            except Exception as e:
                wrong.append(e)
        if wrong:
            raise ExceptionGroup("plugins failed to end", wrong)

    def register_views(self, prefix: str = "") -> list[str]:
        """Governed temporary views for SQL: text queries then see only what the plugins show."""
        for name in self.tables:
            self.table(name).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{n}" for n in self.tables]


class SchemaPlugin(Plugin):
    """Resolves a schema name for each query, from an allow-list, and reads tables from that schema."""

    name, priority = "schema", 900

    def __init__(self, default: str, allowed: Sequence[str] = (), resolve: Callable[[QueryContext], str | None] | None = None, strict: bool = True, read: Callable[[SparkSession, str, str], DataFrame] | None = None):
        self.default, self.allowed, self.resolve, self.strict, self.read = default, allowed, resolve, strict, read

    def schema_of(self, context: QueryContext) -> str:
        wanted = (self.resolve(context) if self.resolve else None) or context.schema or self.default
        if self.allowed and wanted not in self.allowed:
            if self.strict:
                raise BadRequestError(f"schema {wanted} is not allowed")
            return self.default
        return wanted

    def intercept(self, df: DataFrame, context: QueryContext, session: Session) -> DataFrame:
        schema = self.schema_of(context)
        return self.read(session.spark, schema, context.table) if self.read else df


__all__ = ["PluginError", "SchemaPlugin", "Session", "TableSpec"]
