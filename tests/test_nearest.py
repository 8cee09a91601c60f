"""What is nearest is found without meeting all that lies within the radius."""

import random

from pyspark.sql import functions as F

from streetworth.operators import investment as I
from streetworth.operators import network as N
from streetworth.operators import relational as R


def _points(spark, rng, n, key, size=1000):
    return spark.createDataFrame([(i, float(rng.randrange(size)), float(rng.randrange(size))) for i in range(n)], f"{key} long, {key}x double, {key}y double")


def test_nearest_points_without_all_pairs(spark):
    rng = random.Random(1)
    a, b = _points(spark, rng, 300, "a"), _points(spark, rng, 2000, "b").withColumn("kind", F.col("b") % 3)
    ends = a.crossJoin(b.select("kind").distinct())
    least = lambda t: sorted(t.groupBy("a", "kind").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "b"))), 1, 2).alias("l")).collect())
    all_, few = R.within_radius(ends, b, 400.0, ["kind"]), R.nearest(ends, b, 2, 400.0, ["kind"])
    assert least(all_) == least(few) and few.count() < all_.count() / 10
    far = a.withColumns({"ax": F.col("ax") + 5000})  # none within the radius
    assert R.nearest(far, b, 1, 400.0).count() == 0 and R.nearest(a, b.where("false"), 1, 400.0).count() == 0


def test_nearest_segments_without_all_pairs(spark):
    rng = random.Random(2)
    a = _points(spark, rng, 300, "a").withColumn("own", F.col("a") % 5)
    b = _points(spark, rng, 2000, "b")
    lines = b.select("b", F.col("bx").alias("x1"), F.col("by").alias("y1"), (F.col("bx") + F.col("b") % 7 * 9).alias("x2"), (F.col("by") - F.col("b") % 4 * 9).alias("y2"))
    fits = (F.col("b") + F.col("own")) % 6 == 0
    all_ = N.near_segments(a, lines, 300.0).join(a.select("a", "own"), "a").where(fits)
    few = N.nearest_segments(a, lines, 300.0, fits)
    least = lambda t: sorted(t.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).collect())
    assert least(all_) == least(few) and few.count() < all_.count() / 5


def test_points_apart_in_rounds(spark):
    rng = random.Random(3)
    p = _points(spark, rng, 1500, "p").toDF("id", "x", "y")
    kept = []
    for r in sorted(p.collect()):
        if all((r.x - k.x) ** 2 + (r.y - k.y) ** 2 >= 6400 for k in kept):
            kept.append(r)
    assert sorted(I.first_apart(p, 80.0).collect()) == kept
