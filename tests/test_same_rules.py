"""Queries and their SQL follow the same rules, on small tables made for the places where they once differed."""

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from streetworth.catalog import QUERIES, SQL
from streetworth.operators import relational as R


@pytest.fixture
def tables(tmp_path):
    """Writes tables of columns and gives their folder."""

    def write(**frames):
        for name, frame in frames.items():
            pd.DataFrame(frame).to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
        return str(tmp_path)

    return write


def both(spark, d, name):
    """Sorted rows of the query and of its SQL."""
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"):
        if con.sql(f"SELECT * FROM glob('{d}/{t}.parquet')").fetchall():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = QUERIES[name](spark, d)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    return sorted(map(tuple, found.collect()), key=repr), sorted(con.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall(), key=repr)


def test_probabilities_are_held_to_the_twelfth_place(spark, tables):
    lines = {"l_orderkey": [1, 1, 2], "l_partkey": [1, 2, 3], "l_linenumber": [1, 2, 1], "l_extendedprice": [462_000.0, 1000.0, 5.0]}
    orders = {"o_orderkey": [1, 2], "o_custkey": [1, 2], "o_orderstatus": ["O", "F"], "o_orderpriority": ["5-LOW", "1-URGENT"]}
    ours, sql = both(spark, tables(lineitem=lines, orders=orders), "od_ledger_audit")
    assert ours == sql and dict(ours)["probabilities_not_one"] == 1


def test_efficient_rows_are_read_once(spark):
    """Sums of doubles may come out differently each time; here every reading gives other numbers."""
    other = F.udf(lambda x: x + __import__("random").random(), "double").asNondeterministic()
    rows = spark.range(20).select("id", (F.col("id") % 10).cast("double").alias("x")).select("id", other("x").alias("cost"), other("x").alias("benefit"))
    found = R.pareto(rows, "cost", "benefit").collect()
    assert sorted(r.id for r in found) == list(range(20))
    for r in found:
        assert r.efficient == (not any(o.cost <= r.cost and o.benefit >= r.benefit and (o.cost, o.benefit) != (r.cost, r.benefit) for o in found))


def test_ways_of_more_than_600_arcs(spark, tables):
    """A street of 701 nodes; the hub is its first one."""
    keys = [6 + 100 * i for i in range(701)]
    n = keys[-1]
    at = pow(7919, -1, n)
    part = {"p_partkey": keys, "p_size": [1] * 701, "p_retailprice": [900.0] * 701, "p_brand": ["b"] * 701}
    customer = {"c_custkey": [(k - 1) * at % n for k in (keys[1], keys[599], keys[700])], "c_nationkey": [0, 0, 0]}
    ours, sql = both(spark, tables(part=part, customer=customer), "town_costs")
    assert ours == sql and sorted(r[1] for r in ours) == pytest.approx([105 * 1.8 * h for h in (1, 599, 700)])
