"""Queries on polygons: tiles of nations with a hole and a notch, and notched or holed areas around suppliers, whose shared areas SQL adds up from signed rectangles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.operators import areas as A
from streetworth.operators import simplify
from streetworth.operators.graph import shared_dir
from streetworth.plans.fixtures import table
from streetworth.registry import query
from streetworth.sources import geometries as G
from streetworth.sources import writers

_SHAPES = """tiles AS (SELECT n_nationkey AS zone, n_nationkey % 5 * 2000e0 AS zx, n_nationkey // 5 * 2000e0 AS zy FROM nation), zr AS (SELECT zone, unnest([[1, zx, zy, zx + 2000, zy + 2000], [-1, zx + 500, zy + 500, zx + 800, zy + 800], [-1, zx + 1700, zy + 1700, zx + 2000, zy + 2000]]) AS r FROM tiles),
lots AS (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS holed, s_suppkey * 7919 % 23 * 500e0 AS x, s_suppkey * 104729 % 22 * 500e0 AS y, 160e0 + s_suppkey % 4 * 80 AS w FROM supplier),
lr AS (SELECT id, unnest(CASE WHEN holed THEN [[1, x - w, y - w, x + w, y + w], [-1, x - w / 4, y - w / 4, x + w / 4, y + w / 4]] ELSE [[1, x - w, y - w, x + w, y + w], [-1, x, y, x + w, y + w]] END) AS r FROM lots)"""
_SHARED = "a.r[1] * b.r[1] * greatest(0, least(a.r[4], b.r[4]) - greatest(a.r[2], b.r[2])) * greatest(0, least(a.r[5], b.r[5]) - greatest(a.r[3], b.r[3]))"


def _lots(spark: SparkSession, d: str) -> DataFrame:
    """A square with its upper right quarter cut off, or with a hole, around each supplier."""
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(s.alias("id"), (s * 7919 % 23 * 500.0).alias("x"), (s * 104729 % 22 * 500.0).alias("y"), (160.0 + s % 4 * 80).alias("w"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    box = lambda v: A.ring((x - v, y - v), (x + v, y - v), (x + v, y + v), (x - v, y + v))
    notched = A.ring((x - w, y - w), (x + w, y - w), (x + w, y), (x, y), (x, y + w), (x - w, y + w))
    return rows.select("id", F.when(F.col("id") % 2 == 0, F.array(box(w), box(w / 4))).otherwise(F.array(notched)).alias("rings"))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(n.alias("id"), (n % 5 * 2000.0).alias("x"), (F.floor(n / 5) * 2000.0).alias("y"))
    at = lambda i, j: (F.col("x") + i, F.col("y") + j)
    outer = A.ring(at(0, 0), at(2000, 0), at(2000, 1700), at(1700, 1700), at(1700, 2000), at(0, 2000))
    return rows.select("id", F.array(outer, A.ring(at(500, 500), at(800, 500), at(800, 800), at(500, 800))).alias("rings"))


@query(f"WITH {_SHAPES} SELECT a.id, b.zone, round(sum({_SHARED}), 6) AS area FROM lr a JOIN zr b ON true GROUP BY 1, 2 HAVING sum({_SHARED}) > 0")
def zone_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The area that each lot shares with each tile."""
    return A.overlaps(_lots(spark, d), _tiles(spark, d), 1000.0).select(F.col("a").alias("id"), F.col("b").alias("zone"), F.round("area", 6).alias("area"))


@query(f"""WITH {_SHAPES}, p AS (SELECT id, CASE WHEN holed THEN x - w * 5 / 8 ELSE x END AS px, CASE WHEN holed THEN y ELSE y - w / 2 END AS py FROM lots),
m AS (SELECT id, zone FROM p JOIN tiles ON px BETWEEN zx AND zx + 2000 AND py BETWEEN zy AND zy + 2000 AND NOT (px > zx + 500 AND px < zx + 800 AND py > zy + 500 AND py < zy + 800) AND NOT (px > zx + 1700 AND py > zy + 1700)),
s AS (SELECT m.id, m.zone, sum({_SHARED}) AS area FROM m JOIN lr a ON a.id = m.id JOIN zr b ON b.zone = m.zone GROUP BY 1, 2), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY id ORDER BY area DESC, zone) AS nth, lead(area) OVER (PARTITION BY id ORDER BY area DESC, zone) AS next, sum(area) OVER w AS total FROM s WINDOW w AS (PARTITION BY id)),
t AS (SELECT *, area > 0 AND area - next > greatest(1e-6, area * 1e-9) AS clear FROM r WHERE nth = 1)
SELECT id, CASE WHEN n = 1 OR clear THEN zone END AS zone, round(CASE WHEN n = 1 THEN 1e0 WHEN clear THEN area / total END, 8) AS share, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'assigned' WHEN clear THEN 'assigned_by_area' ELSE 'ambiguous' END AS status FROM lots LEFT JOIN t USING (id)""")
def zone_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The tile of each lot: by an interior point, on a shared border by area; ambiguous and missing ones are reported."""
    found = A.assigned_zones(_lots(spark, d), _tiles(spark, d), 1000.0)
    return found.select("id", "zone", F.round("share", 8).alias("share"), "status")


@query(f"WITH {_SHAPES} SELECT id, round(4 * w * w - CASE WHEN holed THEN w * w / 4 ELSE w * w END, 6) AS area, x - w AS xmin, y + w AS ymax FROM lots WHERE x - w <= 6000 AND x + w >= 2000 AND y - w <= 7000 AND y + w >= 3000")
def lots_of_a_box(spark: SparkSession, d: str) -> DataFrame:
    """Lots through files with geometries, of which only those row groups are read whose boxes meet a window."""
    path = f"{shared_dir(spark)}/streetworth/lots-{uuid.uuid4().hex}"
    G.write_geometries(_lots(spark, d), path, "rings", 1000.0, 200)
    rows = G.read_geometries(spark, path, "Polygon", (2000, 3000, 6000, 7000))
    return A.measured(rows).join(rows.select("id", "bbox.xmin", "bbox.ymax"), "id").select("id", F.round("area", 6).alias("area"), "xmin", "ymax")


def _quilt(spark: SparkSession, d: str) -> DataFrame:
    """A field of 1,000 m for each supplier, ten to a row; sides have three points between the corners, by which they bend to one side by 0, 30 or 60 m in the middle."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (k % 10).alias("i"), F.floor(k / 10).alias("j"))

    def side(i: Column, j: Column, across: bool) -> list[tuple[Column, Column]]:
        mark = i * 7 + j * 13 + (0 if across else 5)
        b = (mark % 5 - 2) * 30.0
        a = F.when(mark % 2 == 0, b / 2 + F.signum(b)).otherwise(0.0)
        steps = ((0, F.lit(0.0)), (250, a), (500, b), (750, a))
        return [(i * 1000.0 + s, j * 1000.0 + h) if across else (i * 1000.0 + h, j * 1000.0 + s) for s, h in steps]

    i, j = F.col("i"), F.col("j")
    end = lambda i, j: (i * 1000.0, j * 1000.0)
    border = side(i, j, True) + side(i + 1, j, False) + [end(i + 1, j + 1), *side(i, j + 1, True)[:0:-1]] + [end(i, j + 1), *side(i, j, False)[:0:-1]]
    return rows.select("id", F.array(A.ring(*border)).alias("rings"))


@query("""WITH t AS (SELECT s_suppkey AS id, s_suppkey % 10 AS i, s_suppkey // 10 AS j FROM supplier), s AS (SELECT id, unnest([[i * 7 + j * 13, -1], [i * 7 + (j + 1) * 13, 1], [i * 7 + j * 13 + 5, -1], [(i + 1) * 7 + j * 13 + 5, 1]]) AS m FROM t),
b AS (SELECT id, m[2] AS sign, (m[1] % 5 - 2) * 30e0 AS b, m[1] % 2 = 1 AND abs(m[1] % 5 - 2) = 2 AS sharp FROM s)
SELECT id, round(1000000 + sum(sign * b * CASE WHEN sharp THEN 250 ELSE 500 END), 6) AS area, CAST(4 + sum(CASE WHEN b = 0 THEN 0 WHEN sharp THEN 3 ELSE 1 END) AS BIGINT) AS points FROM b GROUP BY 1""")
def simplified_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose common borders lose points that are off by less than 20 m, as areas and numbers of points."""
    done = simplify.simplified(_quilt(spark, d), 20.0)
    return A.measured(done).select("id", F.round("area", 6).alias("area"), F.size(F.flatten("rings")).cast("long").alias("points"))


@query(f"WITH {_SHAPES} SELECT id, holed, round(4 * w * w - CASE WHEN holed THEN w * w / 4 ELSE w * w END, 6) AS area, CAST(CASE WHEN holed THEN 10 ELSE 7 END AS BIGINT) AS points FROM lots")
def feature_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Lots through lines of GeoJSON polygons with rounded coordinates."""
    path = f"{shared_dir(spark)}/streetworth/polygons-{uuid.uuid4().hex}"
    rows = _lots(spark, d).select(F.col("id").alias("lot"), (F.col("id") % 2 == 0).alias("holed"), G.coordinates(F.col("rings"), "Polygon", 6).alias("coordinates"))
    writers.write_features(rows, path, kind="Polygon")
    back = G.read_shapes(spark, path, "lot: bigint, holed: boolean", "Polygon", by_line=True)
    sizes = A.measured(back.select(F.col("lot").alias("id"), F.col("geometry").alias("rings")))
    return sizes.join(back.select(F.col("lot").alias("id"), "holed"), "id").select("id", "holed", F.round("area", 6).alias("area"), F.size(F.flatten("rings")).cast("long").alias("points"))
