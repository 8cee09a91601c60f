"""Hexagonal cells: the nearest centre, six neighbours at one distance, and back from a centre to its cell."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streetworth.functions.hexes import centre, hexagon, neighbours


def test_cells(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(400)] + [(1000, 0.0, 0.0)]
    rows = spark.createDataFrame(points, "id long, x double, y double").withColumn("h", hexagon(F.col("x"), F.col("y"), 50.0))
    rows = rows.withColumn("c", centre(F.col("h.q"), F.col("h.r"), 50.0)).withColumn("n", neighbours(F.col("h.q"), F.col("h.r")))
    rows = rows.withColumn("m", F.transform("n", lambda h: centre(h["q"], h["r"], 50.0))).withColumn("again", hexagon(F.col("c.x"), F.col("c.y"), 50.0))
    for r in rows.collect():
        own = math.dist((r["x"], r["y"]), r["c"])
        assert own <= 50 + 1e-9 and r["again"] == r["h"] and len(set(r["n"])) == 6
        for m in r["m"]:
            assert math.dist(m, r["c"]) == pytest.approx(50 * math.sqrt(3)) and own <= math.dist((r["x"], r["y"]), m) + 1e-9
