"""Queries that send tables through the writers and readers and return what comes back."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.operators.graph import shared_dir
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table
from streetworth.registry import query
from streetworth.sources import readers, writers


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streetworth/{name}-{uuid.uuid4().hex}"


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '@' ELSE '' END || s_name || ', "x"' AS name, round(s_acctbal, 1) AS credit FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CASE WHEN regexp_matches(name, '^[=+@\\t\\r-]') THEN '''' || name ELSE name END AS name, CAST(credit AS VARCHAR) AS credit FROM s""")
def guarded_csv(spark: SparkSession, d: str) -> DataFrame:
    """Through a CSV file in which no text is a formula, and back with its header checked."""
    path = _path(spark, "csv")
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k, F.concat(F.when(k % 5 == 0, "=").when(k % 5 == 1, "@").otherwise(""), "s_name", F.lit(', "x"')).alias("name"), F.round("s_acctbal", 1).alias("credit"))
    writers.write_guarded_csv(rows, path)
    back = readers.read_csv_checked(spark, path, ["s_suppkey", "name", "credit"])
    return back.select("s_suppkey", "name", F.col("credit").cast("double").cast("string").alias("credit"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def ledger_by_folder(spark: SparkSession, d: str) -> DataFrame:
    """Through a compressed ledger in folders; the scan reads one folder and the columns that are asked for."""
    path = _path(spark, "ledger")
    writers.write_ledger(table(spark, d, "lineitem"), path, ["l_returnflag"])
    return spark.read.parquet(path).where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT p_partkey AS edge, p_brand AS name, CAST(p_partkey * 7919 % 10007 AS DOUBLE) AS x, CAST(p_partkey * 104729 % 10009 AS DOUBLE) AS y, 'Point' AS kind FROM part")
def feature_lines(spark: SparkSession, d: str) -> DataFrame:
    """Through lines of GeoJSON features."""
    path = _path(spark, "features")
    rows = X.points(spark, d, "part", "p_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id")
    writers.write_features(rows.select(F.col("id").alias("edge"), F.col("p_brand").alias("name"), F.array("x", "y").alias("coordinates")), path, kind="Point")
    back = spark.read.schema("type string, geometry struct<type: string, coordinates: array<double>>, properties struct<edge: bigint, name: string>").json(path)
    at = F.col("geometry.coordinates")
    return back.select("properties.edge", "properties.name", at[0].alias("x"), at[1].alias("y"), F.col("geometry.type").alias("kind"))


@query("SELECT o_orderkey AS id, o_custkey AS zone, o_totalprice AS n FROM orders")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Through documents {"records": [...]}, one for each 1,000 orders."""
    path = _path(spark, "records")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("zone"), F.col("o_totalprice").alias("n"))
    rows.groupBy(F.floor(F.col("id") / 1000)).agg(F.collect_list(F.struct("id", "zone", "n")).alias("records")).select(F.to_json(F.struct("records")).alias("value")).write.text(path)
    return spark.read.schema("records array<struct<id: bigint, zone: bigint, n: double>>").json(path).select(F.inline("records"))


@query("SELECT c_nationkey || '.zip' AS archive, CAST(c_custkey AS VARCHAR) AS stop_id, c_name AS stop_name, NULL AS parent_station FROM customer")
def zipped_feed(spark: SparkSession, d: str) -> DataFrame:
    """Through one ZIP archive for each nation, with a member of stops that lacks a column."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("stops.txt", "﻿" + pdf[["stop_id", "stop_name"]].to_csv(index=False))
        return pd.DataFrame({"path": [f"{pdf['zone'].iloc[0]}.zip"], "content": [out.getvalue()]})

    stops = table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_custkey").cast("string").alias("stop_id"), F.col("c_name").alias("stop_name"))
    return readers.unzipped_csv(stops.groupBy("zone").applyInPandas(packed, "path string, content binary"), "stops.txt", ["stop_id", "stop_name", "parent_station"])


@query("SELECT p_partkey AS candidate, p_brand, p_size, p_type FROM part")
def compact_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Through the dictionary form of repeated metrics and back."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("candidate"), "p_brand", "p_size", "p_type")
    references, dictionary = writers.encode_compact(rows, ["p_brand", "p_size", "p_type"])
    return writers.decode_compact(references, dictionary)


@query("""SELECT l_orderkey, '{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || '}' AS json FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)""")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON in the order of their columns' names."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").distinct()
    return rows.select("l_orderkey", writers.canonical_json(rows).alias("json"))


@query("""WITH p AS (SELECT o_orderkey AS id FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT id, count(*) AS pages, CASE WHEN count(*) > 1 THEN 'repeated' ELSE 'ok' END AS status FROM p GROUP BY 1 UNION ALL SELECT NULL, count(*), 'count_differs' FROM orders HAVING count(*) <> 1000""")
def paged_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages of records of which some come twice, against a declared number of 1,000."""
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("page"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return readers.merged_pages(rows.unionByName(rows.where("o_orderstatus = 'P'")), "id", 1000)


@query("""WITH n AS (SELECT p_partkey AS node, CAST(p_partkey * 7919 % 10007 AS DOUBLE) AS x, CAST(p_partkey * 104729 % 10009 AS DOUBLE) AS y FROM part), s AS (SELECT DISTINCT l_orderkey AS way, l_linenumber AS place, l_partkey AS node FROM lineitem), w AS (SELECT DISTINCT way FROM s JOIN n USING (node) WHERE x BETWEEN 2000 AND 3000 AND y BETWEEN 2000 AND 3000)
SELECT way, place, node, x, y FROM s JOIN w USING (way) LEFT JOIN n USING (node)""")
def bounded_ways(spark: SparkSession, d: str) -> DataFrame:
    """Whole ways that touch a box, with their nodes' coordinates."""
    stops = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("node")).distinct()
    return readers.whole_ways(X.points(spark, d, "part", "p_partkey").withColumnRenamed("id", "node"), stops, (2000, 2000, 3000, 3000))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(floor(value / 10) AS BIGINT) AS severity, user_id AS place FROM events WHERE event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-01'""")
def crash_export(spark: SparkSession, d: str) -> DataFrame:
    """An export of crashes as CSV, read with its header checked and filtered by kind and date."""
    path = _path(spark, "crashes")
    table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type", "value", "user_id").write.option("header", True).csv(path)
    rows = readers.read_csv_checked(spark, path, ["event_id", "at", "event_type", "value", "user_id"])
    rows = rows.withColumn("ts", F.to_timestamp("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).where("event_type in ('click', 'error') and ts >= timestamp '2024-01-01'")
    return rows.select(F.col("event_id").cast("long").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.floor(F.col("value").cast("double") / 10).alias("severity"), F.col("user_id").cast("long").alias("place"))
