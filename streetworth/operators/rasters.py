"""Values of raster tiles at points and around them; points meet tiles by equi-joins, and only then their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = ["file", "tile"]


def _met(points: DataFrame, tiles: DataFrame, span: float, reach: float) -> DataFrame:
    """(id, px, py, file, tile) of points(id, x, y) and tiles that come within reach of them; squares of `span` are the key."""
    at = lambda c: F.floor(c / span)
    b = tiles.select(*_KEY, F.col("x").alias("x0"), F.col("y").alias("y1"), (F.col("x") + F.col("width") * F.col("dx")).alias("x1"), (F.col("y") - F.col("height") * F.col("dy")).alias("y0"))
    b = b.withColumn("_cx", F.explode(F.sequence(at(F.col("x0") - reach), at(F.col("x1") + reach)))).withColumn("_cy", F.explode(F.sequence(at(F.col("y0") - reach), at(F.col("y1") + reach))))
    p = points.select("id", F.col("x").alias("px"), F.col("y").alias("py")).where("px is not null and py is not null and not isnan(px) and not isnan(py)").withColumns({"_cx": at(F.col("px")), "_cy": at(F.col("py"))})
    near = (F.col("px") >= F.col("x0") - reach) & (F.col("px") <= F.col("x1") + reach) & (F.col("py") >= F.col("y0") - reach) & (F.col("py") <= F.col("y1") + reach)
    return p.join(b, ["_cx", "_cy"]).where(near).select("id", "px", "py", *_KEY)


def sampled(points: DataFrame, tiles: DataFrame, span: float) -> DataFrame:
    """(id, value) of the cell under each of points(id, x, y), id a key; null where no cell has a value.

    A cell owns its left and its upper border. Of several files that have a value there the first by name counts. `span` is about a tile's width; any value gives the same rows. Tiles are shipped once for each
    join, whatever the number of points; the points of a crowded tile are parted by Spark's handling of skewed joins.
    """
    col, row = F.floor((F.col("px") - F.col("x")) / F.col("dx")), F.floor((F.col("y") - F.col("py")) / F.col("dy"))
    inside = (col >= 0) & (col < F.col("width")) & (row >= 0) & (row < F.col("height"))
    value = F.when(inside, F.get("values", (row * F.col("width") + col).cast("int")))
    found = _met(points, tiles, span, 0.0).join(tiles, _KEY).select("id", *_KEY, value.alias("value")).where("value is not null")
    return points.select("id").join(found.groupBy("id").agg(F.min_by("value", F.struct(*_KEY)).alias("value")), "id", "left")


def around(points: DataFrame, tiles: DataFrame, span: float, radius: float) -> DataFrame:
    """(id, value) for each cell with a value whose middle is at most `radius` away from one of points(id, x, y). Where files overlap, each counts with its own cells."""
    low = lambda v, size, step: F.greatest(F.lit(0), F.floor((v - radius) / step).cast("int"))
    high = lambda v, size, step: F.least(size - 1, F.floor((v + radius) / step).cast("int"))
    right, down = F.col("px") - F.col("x"), F.col("y") - F.col("py")
    c0, c1 = low(right, F.col("width"), F.col("dx")), high(right, F.col("width"), F.col("dx"))
    r0, r1 = low(down, F.col("height"), F.col("dy")), high(down, F.col("height"), F.col("dy"))

    def line(r: Column) -> Column:
        away = lambda i: ((F.col("c0") + i + 0.5) * F.col("dx") - right) ** 2 + ((r + 0.5) * F.col("dy") - down) ** 2
        part = F.slice("values", r * F.col("width") + F.col("c0") + 1, F.col("c1") - F.col("c0") + 1)
        return F.filter(F.transform(part, lambda v, i: F.when(away(i) <= radius * radius, v)), lambda v: v.isNotNull())

    met = _met(points, tiles, span, radius).join(tiles, _KEY).withColumns({"c0": c0, "c1": c1, "r0": r0, "r1": r1}).where("c0 <= c1 and r0 <= r1")
    return met.select("id", F.flatten(F.transform(F.sequence("r0", "r1"), line)).alias("found")).select("id", F.explode("found").alias("value"))


def gathered_tiles(cells: DataFrame, size: int, step: float) -> DataFrame:
    """Tiles of size x size cells of step x step out of cells(col, row, value), rows counted downwards from y = 0; a cell is given once at most, others are null. Tiles without cells are left out."""
    at = lambda c: F.floor(F.col(c) / size)
    place = ((F.col("row") - F.col("ty") * size) * size + F.col("col") - F.col("tx") * size).cast("int")
    each = cells.withColumns({"tx": at("col"), "ty": at("row")}).select("tx", "ty", place.alias("place"), F.col("value").cast("double").alias("value"))
    packed = each.groupBy("tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.try_element_at("m", i))
    return packed.select(
        F.lit("").alias("file"), F.lit(0).alias("tile"), (F.col("tx") * size * step).alias("x"), (-F.col("ty") * size * step).alias("y"), F.lit(float(step)).alias("dx"), F.lit(float(step)).alias("dy"),
        F.lit(size).alias("width"), F.lit(size).alias("height"), values.alias("values"),
    )
