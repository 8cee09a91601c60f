"""Simpler borders that neighbours keep in common: rings are cut where borders meet, and each piece is thinned in the same way from either side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetworth.operators.areas import _RINGS

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def thinned(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a line that are kept: its ends, its farthest point from the chord if that is off it, and within the parts every farthest point beyond the tolerance. Of equal ones the first counts."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    parts = [(0, len(p) - 1, 0.0)]
    while parts:
        a, b, least = parts.pop()
        if b - a < 2:
            continue
        d, away = p[b] - p[a], p[a + 1 : b] - p[a]
        long = float(d @ d)
        along = np.clip(away @ d / long, 0, 1)[:, None] * d if long else 0.0
        far = np.sqrt(((away - along) ** 2).sum(1))
        k = int(far.argmax())
        if far[k] > least:
            keep[a + 1 + k] = True
            parts += [(a, a + 1 + k, tolerance), (a + 1 + k, b, tolerance)]
    return p[keep]


def _oriented(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The same points from whichever end the line is read."""
    backwards = p[::-1].tolist() < p.tolist()
    out = thinned(p[::-1] if backwards else p, tolerance)
    return out[::-1] if backwards else out


def simpler_ring(p: np.ndarray, junctions: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring without its closing point; one that meets no other is cut at its smallest point and the one farthest from that, so that the ring of a hole and of what fills it agree."""
    cuts = np.flatnonzero(junctions)
    if len(cuts) < 2:
        start = int(cuts[0]) if len(cuts) else min(range(len(p)), key=lambda i: p[i].tolist())
        p = np.roll(p, -start, axis=0)
        away = ((p - p[0]) ** 2).sum(1)
        second = min(np.flatnonzero(away == away.max()), key=lambda i: p[i].tolist())
        cuts = np.array([0, second])
    else:
        p, cuts = np.roll(p, -cuts[0], axis=0), cuts - cuts[0]
    closed = np.vstack((p, p[:1]))
    return np.vstack([_oriented(closed[a : b + 1], tolerance)[:-1] for a, b in zip(cuts, [*cuts[1:], len(p)], strict=True)])


def simplified(polygons: DataFrame, tolerance: float) -> DataFrame:
    """(id, rings) of polygons(id, rings), id a key, with fewer points; borders that polygons had in common stay common, so that neither gaps nor overlaps arise along them.

    A point is a junction if it has other than two different neighbours in all rings together; junctions stay. Between them the border is thinned by farthest points; every piece that bends keeps one
    point, so that two pieces between the same junctions don't fall together. Borders are common where their points are equal; a point on another's edge must be in both rings. Pieces that run closer than the tolerance
    to each other may cross. Rings are returned open; repeated points, null points and rings of fewer than three different points are dropped, null rings are empty. The number of neighbours is
    counted by a grouped aggregation, however many polygons meet.
    """
    rings = polygons.select("id", F.posexplode(F.col("rings").cast(_RINGS)).alias("ring", "points"))
    rings = rings.withColumn("points", F.filter("points", lambda v: v["x"].isNotNull() & v["y"].isNotNull()))
    n = F.size("points")
    here = F.col("points")
    fresh = F.filter(here, lambda v, i: v != F.get(here, F.when(i == 0, n - 1).otherwise(i - 1)))
    rings = rings.withColumn("points", F.when(F.size(F.array_distinct("points")) > 2, fresh)).where("points is not null")
    around = F.transform("points", lambda v, i: F.struct(v.alias("at"), F.array(F.get("points", F.pmod(i - 1, n)), F.get("points", F.pmod(i + 1, n))).alias("near")))
    corners = rings.select("id", "ring", F.posexplode(around).alias("place", "c")).select("id", "ring", "place", "c.at", "c.near")
    degree = corners.select("at", F.explode("near").alias("near")).distinct().groupBy("at").agg((F.count("*") != 2).alias("junction"))
    marked = corners.join(degree, "at").groupBy("id", "ring").agg(F.sort_array(F.collect_list(F.struct("place", "at.x", "at.y", "junction"))).alias("points"))
    kind = polygons.schema["id"].dataType.simpleString()

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for points in batch.column("points").to_pylist():
                p = simpler_ring(np.array([(v["x"], v["y"]) for v in points]), np.array([v["junction"] for v in points]), tolerance)
                out.append([{"x": x, "y": y} for x, y in p.tolist()])
            yield pa.record_batch([batch.column("id"), batch.column("ring"), pa.array(out, pa.list_(_POINT))], names=["id", "ring", "points"])

    done = marked.mapInArrow(thin, f"id {kind}, ring int, points array<struct<x:double,y:double>>")
    gathered = done.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("r")).select("id", F.col("r.points").alias("rings"))
    return polygons.select("id").join(gathered, "id", "left").select("id", F.coalesce("rings", F.array().cast(_RINGS)).alias("rings"))
