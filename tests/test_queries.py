"""Every query against the SQL that goes with it, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from dataward import queries

DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(df.columns)
    out = df[columns].copy()
    for c in columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]")
        out[c] = out[c].map(text).astype(object)
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, str(DIR)).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry_works_without_the_optional_package(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_corpus", lambda: None)
    assert set(entry.queries()) >= set(queries.QUERIES) and "pipeline" not in entry.queries()


def test_add_or_insert_where_numbers_are_taken(spark, tmp_path):
    """As on tables of more than 1,000,000 parts."""
    part = spark.read.parquet(str(DIR / "part.parquet"))
    more = part.withColumn("p_partkey", (part.p_partkey + 1000000).cast(dict(part.dtypes)["p_partkey"]))
    part.unionByName(more).write.parquet(str(tmp_path / "part.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = connection.sql(queries.ORACLE_SQL["add_or_insert_state"]).df()
    pd.testing.assert_frame_equal(normal(queries.QUERIES["add_or_insert_state"](spark, str(tmp_path)).toPandas()), normal(want))
