"""A miniature city: six places, seven streets, three journeys and two projects, small enough to follow by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.functions import columns as C
from streetworth.operators.graph import shortest_costs
from streetworth.operators.network import apply_treatments, directed


def city(spark: SparkSession) -> dict[str, DataFrame]:
    """nodes, edges, units (journeys with people, cyclists counted, distance and gradient), candidates."""
    busy, quiet = ("arterial", "mixed_traffic", 50, 4, 15000), ("local", "quiet_street", 30, 2, 500)
    edges = [(u + v, u.upper(), v.upper(), 1000.0, "both", *kind) for kind, names in ((busy, ("ab", "bc", "be")), (quiet, ("de", "ef", "ad", "cf"))) for u, v in names]
    return {
        "nodes": spark.createDataFrame([(n, 1000.0 * (i % 3), 1000.0 * (i // 3)) for i, n in enumerate("ABCDEF")], "node string, x double, y double"),
        "edges": spark.createDataFrame(edges, "edge string, u string, v string, length double, direction string, road_class string, facility string, speed int, lanes int, traffic int"),
        "units": spark.createDataFrame([("west", "A", "C", 1000.0, 30.0, 2.0, 0.3), ("north", "D", "F", 500.0, 15.0, 2.0, 0.2), ("central", "E", "B", 300.0, 6.0, 2.0, 0.4)], "od string, origin string, destination string, eligible double, observed double, distance_km double, gradient double"),
        "candidates": spark.createDataFrame([("main_street", "ab", 2e6), ("main_street", "bc", 2e6), ("central_crossing", "be", 8e5)], "candidate string, edge string, cost double"),
    }


def with_stress(edges: DataFrame) -> DataFrame:
    return edges.withColumn("lts", C.stress_level(F.col("road_class"), F.col("facility"), F.col("speed"), F.col("lanes"), F.col("traffic")))


def treated(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges with the members' protected."""
    return apply_treatments(edges, members.select("edge", F.lit("protected").alias("treatment")))


def connectivity(edges: DataFrame, demand: DataFrame, most: int = 2, detour: float = 1.25) -> DataFrame:
    """One row with the share of demand(od, origin, destination, users) that has a way on streets of at most `most` stress which is at most `detour` times its shortest."""
    arcs = directed(edges).join(with_stress(edges).select("edge", F.col("length").alias("cost"), "lts"), "edge")
    starts = demand.select(F.col("origin").alias("source")).distinct()
    far = lambda t, n: shortest_costs(t.select("u", "v", "cost"), starts, float("inf")).toDF("origin", "destination", n)
    met = demand.join(far(arcs, "near"), ["origin", "destination"], "left").join(far(arcs.where(F.col("lts") <= most), "calm"), ["origin", "destination"], "left")
    return met.agg((F.sum(F.when(F.col("calm") <= detour * F.col("near"), F.col("users")).otherwise(0.0)) / F.sum("users")).alias("share"))
