"""Queries that SQL can express give the same rows as DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from streetworth.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    plain = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
