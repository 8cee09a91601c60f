"""Queries on layers for maps: lines of chains, engine routes against edges, which sources may be published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.operators import network as N
from streetworth.plans.fixtures import table
from streetworth.plans.network import _SEGMENTS, _segments
from streetworth.registry import query


@query(f"""WITH {_SEGMENTS}, p AS (SELECT way, segment * 2 AS i, u AS node FROM segments UNION ALL SELECT way, segment * 2 + 1, v FROM segments), n AS (SELECT *, lag(node) OVER (PARTITION BY way ORDER BY i) AS before FROM p)
SELECT way AS chain, count(*) AS points, string_agg(node * 7919 % 10007 || ' ' || node * 104729 % 10009, ',' ORDER BY i) AS line FROM n WHERE before IS NULL OR before <> node GROUP BY 1""")
def chain_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Each way's line from its segments, of which every other one is stored the other way round."""
    at = lambda c: F.struct((F.col(c) * 7919 % 10007).alias("x"), (F.col(c) * 104729 % 10009).alias("y"))
    turned = (F.col("way") + F.col("segment")) % 2 == 1
    edges = _segments(spark, d).select(F.col("way").alias("chain"), F.col("segment").alias("place"), F.when(turned, F.array(at("v"), at("u"))).otherwise(F.array(at("u"), at("v"))).alias("coordinates"), turned.alias("reversed"))
    text = F.array_join(F.transform("line", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return N.chain_lines(edges).select("chain", F.size("line").cast("long").alias("points"), text.alias("line"))


@query(f"""WITH {_SEGMENTS}, s AS (SELECT way, segment, u, v, 1 + (u + v) % 9 AS length, (u * 31 + v) % 97 = 0 AS lost FROM segments), n AS (SELECT *, lead(u) OVER (PARTITION BY way ORDER BY segment) AS goes FROM s)
SELECT way AS route, CASE WHEN bool_and(lost) THEN 'no_edge_mapped' WHEN bool_or(lost) THEN 'unmapped_edge' WHEN count(*) FILTER (goes <> v) > 0 THEN 'not_contiguous' ELSE 'reconciled' END AS status, round(sum(CASE WHEN lost THEN 0e0 ELSE length END) / sum(length), 8) AS mapped FROM n GROUP BY 1""")
def engine_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Routes of another engine against the edge ledger: whether all their pieces are known edges, one after the other, and how much of their length is."""
    steps = _segments(spark, d).select("way", "segment", "u", "v", (1 + (F.col("u") + F.col("v")) % 9).alias("length"))
    known = steps.select("u", "v").distinct().where("(u * 31 + v) % 97 <> 0").withColumn("known", F.lit(True))
    rows = steps.join(known, ["u", "v"], "left").withColumn("goes", F.lead("u").over(Window.partitionBy("way").orderBy("segment")))
    lost = F.col("known").isNull()
    status = F.when(F.every(lost), "no_edge_mapped").when(F.some(lost), "unmapped_edge").when(F.count_if(F.col("goes") != F.col("v")) > 0, "not_contiguous").otherwise("reconciled")
    return rows.groupBy(F.col("way").alias("route")).agg(status.alias("status"), F.round(F.sum(F.when(lost, 0.0).otherwise(F.col("length"))) / F.sum("length"), 8).alias("mapped"))


@query("""SELECT s_suppkey AS source, CASE WHEN s_nationkey % 3 = 0 THEN 'permitted' WHEN s_nationkey % 3 = 1 THEN 'restricted' ELSE 'unknown' END AS redistribution, CASE WHEN s_nationkey % 3 = 0 AND s_acctbal > 0 THEN 'include' ELSE 'exclude' END AS decision,
CASE WHEN s_acctbal <= 0 THEN 'not_listed_for_export' WHEN s_nationkey % 3 <> 0 THEN 'redistribution_not_permitted' END AS reason FROM supplier""")
def source_rights(spark: SparkSession, d: str) -> DataFrame:
    """A source is published only if it is listed for export and its redistribution is permitted; the others stay, with the reason."""
    r = F.col("s_nationkey") % 3
    kind = F.when(r == 0, "permitted").when(r == 1, "restricted").otherwise("unknown")
    listed = F.col("s_acctbal") > 0
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), kind.alias("redistribution"), F.when((r == 0) & listed, "include").otherwise("exclude").alias("decision"), F.when(~listed, "not_listed_for_export").when(r != 0, "redistribution_not_permitted").alias("reason"))


@query("""WITH t AS (SELECT l_shipdate, o_orderpriority AS purpose, l_quantity AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT purpose, round(sum(n), 3) AS eligible, round(least(sum(n), sum(n * 1.05e0) - 1000), 3) AS assigned, round(greatest(0e0, least(1e0, (sum(n * 1.05e0) - 1000) / sum(n))), 8) AS coverage FROM t GROUP BY 1""")
def activity_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Activity of each purpose and how much of it is covered; a weighted estimate above the total is held at it."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    all_, found = F.sum("l_quantity"), F.sum(F.col("l_quantity") * 1.05) - 1000
    return rows.groupBy(F.col("o_orderpriority").alias("purpose")).agg(F.round(all_, 3).alias("eligible"), F.round(F.least(all_, found), 3).alias("assigned"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found / all_)), 8).alias("coverage"))
