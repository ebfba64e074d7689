"""Tables kept as immutable Parquet snapshots, with a manifest that names the current ones.

A commit writes new snapshot folders and then one manifest: a file that is renamed into place unless one
of its name is there. Where renaming is atomic, as on HDFS, only one of two writers from the same version
succeeds; object stores that copy instead need a single writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError, NotFoundError
from ..functions.text import check_identifier


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> str:
        return f"{self.root}/_manifests"

    def version(self) -> int:
        fs, p = self._fs(self._manifests())
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Table names and their snapshot folders."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self._manifests()}/v{version:09d}").collect()))

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def exists(self, name: str) -> bool:
        return name in self.manifest()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if name not in found:
            raise NotFoundError(f"no table {name}")
        return self.spark.read.parquet(found[name])

    def columns(self, name: str) -> list[tuple[str, str]]:
        return self.read(name).dtypes if self.exists(name) else []

    def commit(self, changes: Mapping[str, DataFrame | None], base: int | None = None) -> int:
        """New snapshots of the changed tables (None drops one) under the next version."""
        base = self.version() if base is None else base
        named = self.manifest(base)
        for name, df in changes.items():
            if df is None:
                named.pop(name, None)
                continue
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            named[name] = path
        fs, waiting = self._fs(f"{self._manifests()}/_{uuid.uuid4().hex}")
        out = fs.create(waiting, False)
        out.writeBytes(json.dumps(named))
        out.close()
        if not self._moved(waiting, f"{self._manifests()}/v{base + 1:09d}"):
            fs.delete(waiting, False)
            raise ConflictError(f"version {base + 1} exists already")
        return base + 1

    def _moved(self, source: Any, target: str) -> bool:
        """Renames a file, unless the target exists: then False."""
        jvm, gateway = self.spark._jvm, self.spark._sc._gateway
        fs = jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(source.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, fs.Path(target), gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    @contextmanager
    def lock(self, name: str = "_lock") -> Iterator[None]:
        """One holder at a time: a file that must not be there yet, and goes at the end."""
        fs, path = self._fs(f"{self.root}/{name}")
        try:
            fs.create(path, False).close()
        except Py4JJavaError as e:
            if "exists" in str(e.java_exception).lower():
                raise ConflictError(f"{name} is held already") from e
            raise
        try:
            yield
        finally:
            fs.delete(path, False)

    def size(self, name: str) -> int:
        """Bytes of the current snapshot; 0 without one."""
        path = self.manifest().get(name)
        if path is None:
            return 0
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength()

    def statistics(self) -> DataFrame:
        """table_name, row_count, size_bytes, index_bytes of all tables; the rows are counted in one job."""
        sizes = self.spark.createDataFrame([(n, self.size(n)) for n in self.tables()], "table_name string, size_bytes long")
        counts = [self.read(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in self.tables()]
        if not counts:
            return self.spark.createDataFrame([], "table_name string, row_count long, size_bytes long, index_bytes long")
        counted = reduce(DataFrame.unionByName, counts).join(sizes, "table_name")
        return counted.select("table_name", "row_count", "size_bytes", F.lit(0).cast("long").alias("index_bytes"))

    def info(self) -> DataFrame:
        """tables, row_count, size_bytes of the whole store."""
        return self.statistics().agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))

    def truncate(self, *names: str) -> dict[str, bool]:
        """Empties tables; False for those that are not there."""
        there = [n for n in names if self.exists(n)]
        self.commit({n: self.read(n).limit(0) for n in there})
        return {n: n in there for n in names}

    def truncate_all(self, exclude: tuple[str, ...] = ()) -> dict[str, bool]:
        return self.truncate(*[n for n in self.tables() if n not in exclude])

    def clone(self, other: Store, data: bool = True) -> None:
        other.commit({n: self.read(n) if data else self.read(n).limit(0) for n in self.tables()})

    def drop(self, *names: str) -> None:
        self.commit(dict.fromkeys(names))

    def create(self, name: str, schema: T.StructType | str) -> None:
        self.commit({name: self.spark.createDataFrame([], schema)})

    def schema_names(self) -> list[str]:
        """Schemas: stores of their own, in folders below this one's."""
        fs, p = self._fs(f"{self.root}/_schemas")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def schema(self, name: str) -> Store:
        if name not in self.schema_names():
            raise NotFoundError(f"no schema {name}")
        return Store(self.spark, f"{self.root}/_schemas/{name}")

    def create_schema(self, name: str, if_not_exists: bool = False) -> Store:
        check_identifier(name, "schema name")
        if name in self.schema_names() and not if_not_exists:
            raise ConflictError(f"schema {name} exists already")
        fs, p = self._fs(f"{self.root}/_schemas/{name}")
        fs.mkdirs(p)
        return self.schema(name)

    def drop_schema(self, name: str, cascade: bool = False) -> None:
        """Refused while the schema has tables, unless they are to go with it."""
        found = self.schema(name)
        if found.tables() and not cascade:
            raise ConflictError(f"schema {name} has tables")
        fs, p = self._fs(found.root)
        fs.delete(p, True)

    def next_id(self, name: str, key: str) -> int:
        return (self.read(name).agg(F.max(key)).first()[0] or 0) + 1


def compare_schemas(first: DataFrame, second: DataFrame) -> DataFrame:
    """name, place (onlyInFirst, onlyInSecond, inBoth) of two lists of names, by set operations."""
    a, b = first.select("name"), second.select("name")
    tag = lambda df, place: df.select("name", F.lit(place).alias("place"))
    return tag(a.exceptAll(b), "onlyInFirst").unionByName(tag(b.exceptAll(a), "onlyInSecond")).unionByName(tag(a.intersect(b), "inBoth"))
