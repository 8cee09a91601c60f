"""Known values and edge cases of the core operators."""

import pytest
from pyspark.sql import functions as F

from streetworth.functions import columns as C
from streetworth.operators import graph as G
from streetworth.operators import relational as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("road,facility,speed,lanes,traffic,level", [("motorway", "protected", 30, 1, 0, 4), ("local", "protected", 90, 4, 90000, 1), ("local", "quiet_street", 30, 2, 500, 1), ("arterial", "mixed_traffic", 50, 4, 15000, 4), ("local", "painted", 50, 3, 15000, 3), ("local", "mixed_traffic", 40, 2, 4000, 2)])
def test_stress_level(spark, road, facility, speed, lanes, traffic, level):
    assert one(spark, C.stress_level(*map(F.lit, (road, facility, speed, lanes, traffic)))) == level


def test_censored_interval(spark):
    assert tuple(one(spark, C.censored_interval(F.lit(-999)))) == (0.0, 2.5, 5.0)
    assert tuple(one(spark, C.censored_interval(F.lit(1)))) == (0.0, 1.0, 3.0)


def test_odds_response_never_falls_or_exceeds(spark):
    assert one(spark, C.odds_response(F.lit(10.0), F.lit(2.0), F.lit(5.0), F.lit(6.0), 0.5)) == 0
    assert one(spark, C.odds_response(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(4.0), 0.5)) == 0
    assert 0 < one(spark, C.odds_response(F.lit(10.0), F.lit(2.0), F.lit(5.0), F.lit(1.0), 9.0)) <= 8


def test_pareto_keeps_equal_rows(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 2.0, 5.0), (4, 3.0, 6.0), (5, 1.0, 4.0)], "id int, cost double, benefit double")
    assert {r["id"] for r in R.pareto(rows, "cost", "benefit").where("efficient").collect()} == {1, 2, 4}


def test_water_fill(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 1.0, 10.0), ("a", 3, 0.0, 5.0), ("b", 4, 0.0, 4.0), ("b", 5, 0.0, 4.0)], "g string, id int, w double, cap double")
    given = {r["id"]: r["given"] for r in R.water_fill(rows, ["g"], "w", "cap", F.lit(6.0)).collect()}
    assert given == {1: 1.0, 2: 5.0, 3: 0.0, 4: 3.0, 5: 3.0}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 10), (10, 11)], "a long, b long")
    assert {tuple(r) for r in G.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), *((i, 7) for i in range(7, 12))}
    arcs = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0), (4, 1, 1.0)], "u long, v long, cost double")
    found = {tuple(r) for r in G.shortest_costs(arcs, spark.createDataFrame([(1,)], "source long"), 10.0).collect()}
    assert found == {(1, 1, 0.0), (1, 3, 1.0), (1, 2, 2.0), (1, 4, 3.0)}
