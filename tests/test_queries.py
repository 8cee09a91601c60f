"""Every query with an oracle gives the same rows as DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from streetworth.catalog import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.astype({c: "float64" for c in df.columns if pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(spark, con, name):
    pd.testing.assert_frame_equal(plain(QUERIES[name](spark, DIR).toPandas()), plain(con.sql(SQL[name]).df()), check_dtype=False, rtol=0, atol=0)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
