"""The domain's inputs, derived from the driver's tables: ledgers of paths, demand, projects, edges, counts and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THETA, ELASTICITY = 0.05, 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_edges(spark: SparkSession, d: str) -> DataFrame:
    """od = order, path = line number, edge = part; cost in thousands."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("od"), F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("edge"), "l_extendedprice")
    return rows.groupBy("od", "path", "edge").agg((F.sum("l_extendedprice") / 1000).alias("cost"))


def paths(edges: DataFrame) -> DataFrame:
    return edges.groupBy("od", "path").agg(F.sum("cost").alias("cost"))


def ods(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("od"))
    return rows.agg(F.sum("l_quantity").alias("eligible"), (F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / 4).alias("base"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("candidate")).agg(F.sum("p_retailprice").alias("cost"), F.sum(F.col("p_size") * 10.0).alias("users"), F.sum(F.col("p_size") * F.col("p_retailprice")).alias("km"))


def project_edges(spark: SparkSession, d: str) -> DataFrame:
    """keep = treated multiplier / untreated multiplier of the part's stress level, 1 + size mod 4."""
    multiplier = F.element_at(F.array(F.lit(1.0), F.lit(1.2), F.lit(1.6), F.lit(2.2)), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("edge"), F.col("p_brand").alias("candidate"), (1.0 / multiplier).alias("keep"))


def streets(spark: SparkSession, d: str) -> DataFrame:
    """One street for each part, with speed, lanes or traffic unknown on some."""
    p = F.col("p_partkey")
    classes, kinds = F.array(*map(F.lit, ("motorway", "arterial", "collector", "local", "service", "path"))), F.array(*map(F.lit, ("mixed_traffic", "painted", "quiet_street", "protected", "shared")))
    return table(spark, d, "part").select(
        p.alias("edge"), F.element_at(classes, (p % 6 + 1).cast("int")).alias("road_class"), F.element_at(kinds, (F.col("p_size") % 5 + 1).cast("int")).alias("facility"),
        F.when(p % 4 != 0, (20 + p % 5 * 10)).cast("int").alias("speed"), F.when(p % 3 != 0, (1 + p % 4)).cast("int").alias("lanes"), F.when(p % 5 != 0, p % 17 * 1000).cast("int").alias("traffic"),
        ((p % 21 - 10) / 100.0).alias("gradient"), (p % 50 == 0).alias("tunnel"), (p % 20 == 0).alias("bridge"), F.col("p_retailprice").alias("length_m"),
    )


def points(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, d, name).select(k.alias("id"), (k * 7919 % 10007).cast("double").alias("x"), (k * 104729 % 10009).cast("double").alias("y"))


#: The same derivations for DuckDB.
CTE = {
    "path_edges": "SELECT l_orderkey AS od, l_linenumber AS path, l_partkey AS edge, sum(l_extendedprice) / 1000e0 AS cost FROM lineitem GROUP BY 1, 2, 3",
    "paths": "SELECT od, path, sum(cost) AS cost FROM path_edges GROUP BY 1, 2",
    "ods": "SELECT l_orderkey AS od, sum(l_quantity) AS eligible, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0e0 END) / 4e0 AS base FROM lineitem GROUP BY 1",
    "projects": "SELECT p_brand AS candidate, sum(p_retailprice) AS cost, sum(p_size * 10e0) AS users, sum(p_size * p_retailprice) AS km FROM part GROUP BY 1",
    "project_edges": "SELECT p_partkey AS edge, p_brand AS candidate, 1e0 / (CASE p_size % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1.2e0 WHEN 2 THEN 1.6e0 ELSE 2.2e0 END) AS keep FROM part",
    "streets": """SELECT p_partkey AS edge, (['motorway','arterial','collector','local','service','path'])[p_partkey % 6 + 1] AS road_class,
        (['mixed_traffic','painted','quiet_street','protected','shared'])[p_size % 5 + 1] AS facility, CASE WHEN p_partkey % 4 <> 0 THEN 20 + p_partkey % 5 * 10 END AS speed,
        CASE WHEN p_partkey % 3 <> 0 THEN 1 + p_partkey % 4 END AS lanes, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 17 * 1000 END AS traffic,
        (p_partkey % 21 - 10) / 100e0 AS gradient, p_partkey % 50 = 0 AS tunnel, p_partkey % 20 = 0 AS bridge, p_retailprice AS length_m FROM part""",
}


def with_(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names.split()) + (", " if body.lstrip().startswith(",") else " ") + body.lstrip().lstrip(",")
