"""A query on hexagonal cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.functions.hexes import centre, hexagon, neighbours
from streetworth.plans import fixtures as X
from streetworth.registry import query

SIZE = 260.0


@query(f"""WITH p AS (SELECT (c_custkey * 7919 % 10007)::DOUBLE AS x, (c_custkey * 104729 % 10009)::DOUBLE AS y FROM customer), a AS (SELECT (x * {math.sqrt(3)!r} / 3 - y / 3) / {SIZE} AS fq, y * 2 / 3 / {SIZE} AS fr FROM p),
b AS (SELECT *, CAST(floor(fq + 0.5) AS BIGINT) AS i, CAST(floor(fr + 0.5) AS BIGINT) AS j, CAST(floor(-fq - fr + 0.5) AS BIGINT) AS k FROM a), d AS (SELECT *, abs(i - fq) AS dq, abs(j - fr) AS dr, abs(k + fq + fr) AS ds FROM b),
h AS (SELECT CASE WHEN dq > dr AND dq > ds THEN -j - k ELSE i END AS q, CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -i - k ELSE j END AS r FROM d), n AS (SELECT q, r, count(*) AS people FROM h GROUP BY 1, 2),
around AS (SELECT q + a AS q, r + b AS r, sum(people) AS near FROM n, (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) s(a, b) GROUP BY 1, 2)
SELECT q, r, coalesce(people, 0) AS people, CAST(coalesce(near, 0) AS BIGINT) AS near, round({SIZE * math.sqrt(3)!r} * (q + r / 2e0), 4) AS x, round({SIZE * 1.5!r} * r, 4) AS y FROM n FULL JOIN around USING (q, r)""")
def hexagon_surface(spark: SparkSession, d: str) -> DataFrame:
    """People in each hexagon and in the six around it, for every cell that has or touches some."""
    at = X.points(spark, d, "customer", "c_custkey").select(hexagon(F.col("x"), F.col("y"), SIZE).alias("h"))
    own = at.groupBy("h.q", "h.r").agg(F.count("*").alias("people"))
    around = own.select(F.explode(neighbours(F.col("q"), F.col("r"))).alias("h"), "people").groupBy("h.q", "h.r").agg(F.sum("people").alias("near"))
    rows = own.join(around, ["q", "r"], "full").fillna(0, ["people", "near"])
    middle = centre(F.col("q"), F.col("r"), SIZE)
    return rows.select("q", "r", "people", "near", F.round(middle["x"], 4).alias("x"), F.round(middle["y"], 4).alias("y"))
