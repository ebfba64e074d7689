"""Dumps, fixtures and scripts: tables out to text and back."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequestError
from ..functions.text import quoted

DUMP_VERSION = "1.0"


def dump_json(tables: Mapping[str, DataFrame], path: str, schema_only: bool = False, data_only: bool = False) -> None:
    """A folder with JSON lines for each table, and a manifest with their schemas."""
    manifest: dict[str, Any] = {"version": DUMP_VERSION, "timestamp": datetime.now(timezone.utc).isoformat(), "tables": {}}
    for name, df in tables.items():
        manifest["tables"][name] = {} if data_only else {"schema": json.loads(df.schema.json())}
        if not schema_only:
            df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/_manifest").collect()))


def restore_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a JSON dump, with the schemas that it holds."""
    out = {}
    for name, entry in read_manifest(spark, path)["tables"].items():
        reader = spark.read.schema(T.StructType.fromJson(entry["schema"])) if "schema" in entry else spark.read
        out[name] = reader.json(f"{path}/{name}")
    return out


def restore_document(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables of one JSON document {"tables": {name: {"data": [rows]}}}."""
    inner = ", ".join(f"{quoted(n)}: struct<data: array<struct<{s}>>>" for n, s in schemas.items())
    doc = spark.read.schema(f"tables struct<{inner}>").option("multiLine", True).json(path)
    return {n: doc.select(F.explode(f"tables.{n}.data").alias("r")).select("r.*") for n in schemas}


def sql_literal(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif isinstance(kind, T.NumericType):
        text = c.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """statement: one INSERT for each row."""
    values = F.concat_ws(", ", *[sql_literal(F.col(quoted(f.name)), f.dataType) for f in df.schema.fields])
    names = ", ".join(map(quoted, df.columns))
    return df.select(F.concat(F.lit(f"INSERT INTO {quoted(table)} ({names}) VALUES ("), values, F.lit(");")).alias("statement"))


def create_statement(df: DataFrame, table: str) -> str:
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)
    return f"CREATE TABLE {quoted(table)} ({columns});"


def dump_sql(tables: Mapping[str, DataFrame], path: str, drop: bool = False, schema_only: bool = False, data_only: bool = False) -> None:
    """A folder for each table with its statements in order of file: DROP (if asked for), CREATE, and the INSERTs."""
    for name, df in tables.items():
        head = [f"DROP TABLE IF EXISTS {quoted(name)};"] * drop + [create_statement(df, name)] * (not data_only)
        if head:
            df.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/0_schema")
        if not schema_only:
            insert_statements(df, name).select(F.col("statement").alias("value")).write.mode("overwrite").text(f"{path}/{name}/1_data")


def split_statements(script: str) -> Iterator[str]:
    """Statements of a script; semicolons in quotes and comments do not end one."""
    start, at, quote = 0, 0, ""
    while at < len(script):
        c = script[at]
        if quote:
            if script.startswith(quote, at):
                at += len(quote) - 1
                quote = ""
        elif c in "'\"`":
            quote = c
        elif script.startswith("--", at):
            quote = "\n"
        elif script.startswith("/*", at):
            quote = "*/"
        elif c == ";":
            if statement := script[start:at].strip():
                yield statement
            start = at + 1
        at += 1
    if statement := script[start:].strip():
        yield statement


def run_script(spark: SparkSession, script: str) -> int:
    done = 0
    for statement in split_statements(script):
        spark.sql(statement)
        done += 1
    return done


def save_fixture(tables: Mapping[str, DataFrame], path: str, tags: Iterable[str] = ()) -> None:
    """Small tables in one JSON file, for tests."""
    data = {n: [json.loads(x) for x in df.toJSON().collect()] for n, df in tables.items()}
    Path(path).write_text(json.dumps({"metadata": {"tags": list(tags)}, "data": data}, indent=1))


def parse_fixture(text: str, suffix: str) -> dict[str, Any]:
    if suffix == ".json":
        found = json.loads(text)
    elif suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise BadRequestError("YAML fixtures need a YAML library") from e
        found = yaml.safe_load(text)
    else:
        raise BadRequestError(f"fixtures of kind {suffix} can't be read")
    return found if "data" in found else {"metadata": {}, "data": found}


def load_fixture(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType], tags: Iterable[str] = ()) -> dict[str, DataFrame]:
    """A fixture's tables; none if tags are asked for and it bears none of them."""
    found = parse_fixture(Path(path).read_text(), Path(path).suffix)
    if (wanted := set(tags)) and not wanted & set(found["metadata"].get("tags", [])):
        return {}
    if unknown := set(found["data"]) - set(schemas):
        raise BadRequestError(f"tables without a schema: {', '.join(sorted(unknown))}")
    return {n: spark.createDataFrame([tuple(r.get(c) for c in schemas[n].names) for r in rows], schemas[n]) for n, rows in found["data"].items()}
