"""What SQL can say of the corpus operators, held against their queries."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from dataward.llm import queries

from ..test_queries import normal

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["rules_of_urls", "targets_of_mix", "hashes_of_edits", "counts_of_pii"])
def test_query(spark, name):
    connection = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, str(DIR)).toPandas(), connection.sql(queries.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want))
