"""Overlay of polygons: exact areas of intersections, interior points, and the zone that an area belongs to.

A polygon is rings: array<array<struct<x, y>>>, closed or not; a place is inside if it lies in an odd number of them, so holes are further rings and self-crossings
are cut out. Pairs are found by an equi-join on grid cells and measured in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetworth.operators.graph import _save


def edges(rings: list[list[dict]] | None) -> np.ndarray:
    """Rows (x1, y1, x2, y2) of all rings, without those of no length."""
    out = []
    for ring in rings or []:
        p = np.array([(v["x"], v["y"]) for v in ring or [] if v is not None and v["x"] is not None and v["y"] is not None], float).reshape(-1, 2)
        if len(p) > 2:
            out.append(np.hstack((p, np.roll(p, -1, axis=0))))
    e = np.concatenate(out) if out else np.zeros((0, 4))
    return e[(e[:, :2] != e[:, 2:]).any(1)]


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    d = e[:, 2:] - e[:, :2]
    det = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = e[None, :, :2] - e[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / det
        t = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / det
    i, j = np.nonzero((det != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1))
    return e[i, 1] + s[i, j] * d[i, 1]


def _sections(e: np.ndarray, y: float) -> np.ndarray:
    """The x at which edges meet a horizontal line, in order: inside lies between the first and the second, the third and the fourth..."""
    hit = e[(e[:, 1] > y) != (e[:, 3] > y)]
    return np.sort(hit[:, 0] + (y - hit[:, 1]) / (hit[:, 3] - hit[:, 1]) * (hit[:, 2] - hit[:, 0]))


def _common(a: np.ndarray, b: np.ndarray) -> float:
    """Length that two lists of sections share."""
    if not len(a) or not len(b):
        return 0.0
    low, high = np.maximum(a[0::2, None], b[None, 0::2]), np.minimum(a[1::2, None], b[None, 1::2])
    return float(np.maximum(high - low, 0).sum())


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two polygons share: between the heights of vertices and crossings edges don't meet, so widths are linear there, and the width in the middle times the height is exact."""
    if not len(a) or not len(b):
        return 0.0
    low, high = max(a[:, [1, 3]].min(), b[:, [1, 3]].min()), min(a[:, [1, 3]].max(), b[:, [1, 3]].max())
    if low >= high:
        return 0.0
    both = np.concatenate((a, b))
    ys = np.unique(np.concatenate((both[:, 1], _crossings(both), [low, high])))
    ys = ys[(ys >= low) & (ys <= high)]
    return float(sum((top - y) * _common(_sections(a, (y + top) / 2), _sections(b, (y + top) / 2)) for y, top in zip(ys[:-1], ys[1:], strict=True)))


def interior(e: np.ndarray) -> tuple[float, float] | None:
    """A point inside: the middle of the widest section, of equal ones (within a billionth, as places are rounded) the left, halfway up the slab between vertices that holds the middle height (or ends there). None for no area."""
    ys = np.unique(np.concatenate((e[:, 1], _crossings(e)))) if len(e) else np.zeros(0)
    if len(ys) < 2:
        return None
    k = int(np.clip(np.searchsorted(ys, (ys[0] + ys[-1]) / 2), 1, len(ys) - 1))
    y = (ys[k - 1] + ys[k]) / 2
    x = _sections(e, y)
    widths = x[1::2] - x[0::2]
    best = int(np.argmax(widths >= widths.max() * (1 - 1e-9))) if len(widths) else -1
    return ((x[2 * best] + x[2 * best + 1]) / 2, y) if best >= 0 and widths[best] > 0 else None


def covers(e: np.ndarray, x: float, y: float) -> bool:
    """Whether a point is inside or on the border."""
    if not len(e):
        return False
    d, p = e[:, 2:] - e[:, :2], np.array([x, y]) - e[:, :2]
    along = (p * d).sum(1) / (d * d).sum(1)
    on = (np.abs(d[:, 0] * p[:, 1] - d[:, 1] * p[:, 0]) <= 1e-9 * np.sqrt((d * d).sum(1))) & (along >= 0) & (along <= 1)
    return bool(on.any() or (_sections(e, y) > x).sum() % 2)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(area, point) of each row's rings, as the columns `area` and `point`."""
    for batch in batches:
        areas, points = [], []
        for rings in batch.column("rings").to_pylist():
            e = edges(rings)
            areas.append(overlap(e, e))
            p = interior(e)
            points.append({"x": p[0], "y": p[1]} if p else None)
        yield pa.record_batch([batch.column("id"), batch.column("rings"), pa.array(areas, pa.float64()), pa.array(points, pa.struct([("x", pa.float64()), ("y", pa.float64())]))], names=["id", "rings", "area", "point"])


_RINGS = "array<array<struct<x:double,y:double>>>"


def measured(polygons: DataFrame) -> DataFrame:
    """polygons(id, rings) with area and an interior point (null without an area; null rings are empty)."""
    kind = polygons.schema["id"].dataType.simpleString()
    return polygons.select("id", F.col("rings").cast(_RINGS)).mapInArrow(_measured, f"id {kind}, rings {_RINGS}, area double, point struct<x:double,y:double>")


def _boxed(polygons: DataFrame, s: str) -> DataFrame:
    """The polygon's box, from all of its vertices."""
    of = lambda f, c: f(F.transform(F.flatten("rings"), lambda p: p[c]))
    box = {f"{s}x0": of(F.array_min, "x"), f"{s}y0": of(F.array_min, "y"), f"{s}x1": of(F.array_max, "x"), f"{s}y1": of(F.array_max, "y")}
    return polygons.select(F.col("id").alias(s), F.col("rings").cast(_RINGS).alias(f"{s}_rings"), *[v.alias(k) for k, v in box.items()]).where(f"{s}x0 is not null and {s}y0 is not null")


def _overlapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        areas = [overlap(edges(a), edges(b)) for a, b in zip(batch.column("a_rings").to_pylist(), batch.column("b_rings").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(areas, pa.float64())], names=["a", "b", "area"])


def overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(a, b, area) of the polygons(id, rings) of two tables that share an area. Boxes meet by the grid cells of width `cell` that they touch, each pair in one cell only: that of its boxes' common lower left corner."""
    a, b = _boxed(left, "a"), _boxed(right, "b")
    at = lambda c: F.floor(F.col(c) / cell)
    spread = lambda t, s: t.withColumn("_cx", F.explode(F.sequence(at(f"{s}x0"), at(f"{s}x1")))).withColumn("_cy", F.explode(F.sequence(at(f"{s}y0"), at(f"{s}y1"))))
    met = spread(a, "a").join(spread(b, "b"), ["_cx", "_cy"]).where("ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1")
    met = met.where((F.col("_cx") == F.floor(F.greatest("ax0", "bx0") / cell)) & (F.col("_cy") == F.floor(F.greatest("ay0", "by0") / cell)))
    kinds = f"a {left.schema['id'].dataType.simpleString()}, b {right.schema['id'].dataType.simpleString()}, area double"
    return met.select("a", "b", "a_rings", "b_rings").mapInArrow(_overlapped, kinds).where("area > 0")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points, rings = batch.column("point").to_pylist(), batch.column("b_rings").to_pylist()
        inside = [covers(edges(r), p["x"], p["y"]) for p, r in zip(points, rings, strict=True)]
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(inside, pa.bool_())], names=["a", "b", "inside"])


def assigned_zones(areas: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """(id, zone, share, status) of each of areas(id, rings): the zone of zones(id, rings) that its interior point lies in, borders included.

    Where that holds for several, the one that shares most area with it, by more than a billionth of that; `share` is its part of what they share, else 1. status: assigned, assigned_by_area, ambiguous (equal
    areas), missing (no zone), no_area. Both ids are keys; the other statuses have no zone.
    """
    told = _save(measured(areas))
    b = _boxed(zones, "b")
    at = lambda c: F.floor(c / cell)
    cells = b.withColumn("_cx", F.explode(F.sequence(at(F.col("bx0")), at(F.col("bx1"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("by0")), at(F.col("by1")))))
    asked = told.where("point is not null").select(F.col("id").alias("a"), "point", at(F.col("point.x")).alias("_cx"), at(F.col("point.y")).alias("_cy"))
    kinds = f"a {areas.schema['id'].dataType.simpleString()}, b {zones.schema['id'].dataType.simpleString()}"
    near = asked.join(cells, ["_cx", "_cy"]).where("point.x between bx0 and bx1 and point.y between by0 and by1").select("a", "b", "point", "b_rings")
    inside = _save(near.mapInArrow(_covered, kinds + ", inside boolean").where("inside").select("a", "b"))
    counts = inside.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("only"))
    several = counts.where("n > 1").select("a")
    pairs = inside.join(several, "a").join(told.select(F.col("id").alias("a"), F.col("rings").alias("a_rings")), "a").join(b.select("b", "b_rings"), "b")
    shared = pairs.select("a", "b", "a_rings", "b_rings").mapInArrow(_overlapped, kinds + ", area double")
    own = Window.partitionBy("a").orderBy(F.desc("area"), "b")
    ranked = shared.withColumn("nth", F.row_number().over(own)).withColumn("next", F.lead("area").over(own)).withColumn("all", F.sum("area").over(Window.partitionBy("a"))).where("nth = 1")
    clear = (F.col("area") > 0) & (F.col("area") - F.col("next") > F.greatest(F.lit(1e-6), F.col("area") * 1e-9))
    won = ranked.select("a", F.when(clear, F.col("b")).alias("won"), F.when(clear, F.col("area") / F.col("all")).alias("share"))
    rows = told.select(F.col("id").alias("a"), "point").join(counts, "a", "left").join(won, "a", "left")
    status = F.when(F.col("point").isNull(), "no_area").when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "assigned").when(F.col("won").isNotNull(), "assigned_by_area").otherwise("ambiguous")
    one = F.col("n") == 1
    return rows.select(F.col("a").alias("id"), F.when(one, F.col("only")).otherwise(F.col("won")).alias("zone"), F.when(one, 1.0).otherwise(F.col("share")).alias("share"), status.alias("status"))


def ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))
