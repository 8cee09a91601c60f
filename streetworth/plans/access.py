"""Access rules of segments, derived from order lines (each line is a rule of its order's segment), and who may use what under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.functions import access as A
from streetworth.plans.fixtures import table
from streetworth.registry import query


def segments(spark: SparkSession, d: str) -> DataFrame:
    """segment, open_by_class, rules in the order of their positions."""
    q = F.col("l_quantity").cast("long")
    names = lambda *x: F.array(*map(F.lit, x))
    modes = F.get(F.array(names("bicycle"), names("foot"), names("motor_vehicle"), names("vehicle", "foot")), (F.col("l_suppkey") % 5 - 1).cast("int"))
    heading = F.when(q % 3 == 1, "forward").when(q % 3 == 2, "backward")
    kind = F.when(F.col("l_returnflag") == "A", "allowed").when(F.col("l_returnflag") == "N", "denied").otherwise("designated")
    part = F.col("l_linenumber") % 3 == 0
    rule = F.struct(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), kind.alias("kind"), heading.alias("heading"), F.coalesce(modes, F.array().cast("array<string>")).alias("modes"),
        F.when(F.col("l_discount") > 0.085, names("as_customer")).alias("users"), F.lit(None).cast("array<string>").alias("recognized"), F.when(F.col("l_tax") > 0.07, "Mo-Fr").alias("during"),
        (F.col("l_suppkey") % 11 == 0).alias("vehicle"), F.when(part, 0.2).alias("from_"), F.when(part, 0.6).alias("to_"),
    )
    rules = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("segment")).agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    rules = rules.withColumn("rules", F.transform("rules", lambda r: r.dropFields("at")))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment"), (F.col("o_orderstatus") != "F").alias("open_by_class"))
    return orders.join(rules, "segment", "left").withColumn("rules", F.coalesce("rules", F.array().cast(A.RULES)))


_RULES = """rules AS (SELECT l_orderkey AS segment, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE l_returnflag WHEN 'A' THEN 'allowed' WHEN 'N' THEN 'denied' ELSE 'designated' END AS kind, CASE CAST(l_quantity AS BIGINT) % 3 WHEN 1 THEN 'forward' WHEN 2 THEN 'backward' END AS heading,
  CASE l_suppkey % 5 WHEN 1 THEN 'bicycle' WHEN 2 THEN 'foot' WHEN 3 THEN 'motor_vehicle' WHEN 4 THEN 'vehicle,foot' ELSE '' END AS modes, CASE WHEN l_linenumber % 3 = 0 THEN 0.2e0 END AS from_, CASE WHEN l_linenumber % 3 = 0 THEN 0.6e0 END AS to_
  FROM lineitem WHERE NOT l_discount > 0.085 AND NOT l_tax > 0.07 AND l_suppkey % 11 <> 0)"""
_BEST = """SELECT segment{more}, kind FROM (SELECT *, row_number() OVER (PARTITION BY segment{more} ORDER BY (CASE WHEN heading IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN modes <> '' THEN 1 ELSE 0 END) DESC, pos DESC) AS n FROM {rules} WHERE {binds}) WHERE n = 1"""
_FOOT = "heading IS NULL AND (modes = '' OR contains(modes, 'foot'))"
_BIKE = "(heading IS NULL OR heading = '{0}') AND (modes = '' OR modes IN ('bicycle', 'vehicle,foot'))"


@query(f"""WITH {_RULES}, foot AS ({_BEST.format(more='', rules='rules', binds=_FOOT)}), fore AS ({_BEST.format(more='', rules='rules', binds=_BIKE.format('forward'))}), back AS ({_BEST.format(more='', rules='rules', binds=_BIKE.format('backward'))})
SELECT o_orderkey AS segment, coalesce(foot.kind <> 'denied', o_orderstatus <> 'F') AS walk, coalesce(fore.kind <> 'denied', o_orderstatus <> 'F') AS ride_forward, coalesce(back.kind <> 'denied', o_orderstatus <> 'F') AS ride_backward
FROM orders LEFT JOIN foot ON foot.segment = o_orderkey LEFT JOIN fore ON fore.segment = o_orderkey LEFT JOIN back ON back.segment = o_orderkey""")
def access_rules_open(spark: SparkSession, d: str) -> DataFrame:
    """Who may use each segment, by its access rules."""
    rules, usual = F.col("rules"), F.col("open_by_class")
    ride = [A.open_to(rules, "bicycle", F.lit(h), usual).alias(f"ride_{h}") for h in ("forward", "backward")]
    return segments(spark, d).select("segment", A.open_to(rules, "foot", None, usual).alias("walk"), *ride)


@query(f"""WITH {_RULES}, cuts AS (SELECT o_orderkey AS segment, o_orderstatus <> 'F' AS usual, o_totalprice / 100 AS length, (o_custkey % 7 + 1) / 8e0 AS cut FROM orders),
parts AS (SELECT segment, usual, length, 0 AS part, 0e0 AS a, cut AS b FROM cuts UNION ALL SELECT segment, usual, length, 1, cut, 1e0 FROM cuts),
own AS (SELECT segment, part, r.* EXCLUDE (segment) FROM parts JOIN rules r USING (segment) WHERE from_ IS NULL OR greatest(a, from_) < least(b, to_) - 1e-9),
fore AS ({_BEST.format(more=', part', rules='own', binds=_BIKE.format('forward'))})
SELECT segment, part, round((b - a) * length, 8) AS length, coalesce(kind <> 'denied', usual) AS ride_forward FROM parts LEFT JOIN fore USING (segment, part)""")
def segment_edges_access(spark: SparkSession, d: str) -> DataFrame:
    """Segments cut at their connectors; a rule for a part of the segment holds only on edges that it overlaps."""
    more = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment"), (F.col("o_totalprice") / 100).alias("length"), F.array(F.lit(0.0), (F.col("o_custkey") % 7 + 1) / 8.0, F.lit(1.0)).alias("at"))
    each = segments(spark, d).join(more, "segment").select("*", F.posexplode(F.slice("at", 1, 2)).alias("part", "a")).withColumn("b", F.col("at")[F.col("part") + 1])
    rules = A.rules_between(F.col("rules"), F.col("a"), F.col("b"))
    return each.select("segment", "part", F.round((F.col("b") - F.col("a")) * F.col("length"), 8).alias("length"), A.open_to(rules, "bicycle", F.lit("forward"), F.col("open_by_class")).alias("ride_forward"))
