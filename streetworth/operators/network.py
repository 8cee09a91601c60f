"""Operators on networks: segments of ways, chains, splits, snapping, point-to-segment matching, accessibility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetworth.operators.graph import _save, components
from streetworth.operators.relational import nearest_pairs


def segments(stops: DataFrame) -> DataFrame:
    """Segments (way, segment, u, v) between consecutive nodes of stops(way, place, node); none where a node follows itself."""
    order = Window.partitionBy("way").orderBy("place")
    numbered = stops.withColumns({"segment": F.row_number().over(order) - 1, "v": F.lead("node").over(order)})
    return numbered.where("v is not null and v <> node").select("way", "segment", F.col("node").alias("u"), "v")


def directed(edges: DataFrame) -> DataFrame:
    """Arcs (edge, u, v, forward) of edges(edge, u, v, direction), direction being both, forward or reverse."""
    one = F.struct(F.col("u").alias("u"), F.col("v").alias("v"), F.lit(True).alias("forward"))
    other = F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("forward"))
    ends = F.when(F.col("direction") == "forward", F.array(one)).when(F.col("direction") == "reverse", F.array(other)).otherwise(F.array(one, other))
    return edges.select("edge", F.explode(ends).alias("_a")).select("edge", "_a.*")


def chains(edges: DataFrame) -> DataFrame:
    """(id, chain, closed): edges(id, u, v) that follow each other through nodes of degree 2 form one chain, named by its smallest id.

    A chain that comes back to the node it started from gives up the larger of its two edges there, which then stands alone; a ring without any other node is
    marked closed. Parallel edges count as often as they occur. Components of edges, so no chain is walked in one task.
    """
    ends = edges.select("id", F.explode(F.array("u", "v")).alias("node"))
    sizes = ends.groupBy("node").agg(F.count("*").alias("degree"), F.min("id").alias("a"), F.max("id").alias("b"))
    linked = components(sizes.where("degree = 2 and a <> b").select("a", "b"))
    named = _save(edges.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("chain")))
    tips = ends.join(sizes.where("degree <> 2").select("node"), "node").join(named, "id")
    outer = tips.groupBy("chain").agg(F.count_distinct("node").alias("tips"), F.count("*").alias("touches"), F.max("id").alias("last"), F.count_distinct("id").alias("distinct"))
    out = named.join(outer, "chain", "left")
    loop = (F.col("tips") == 1) & (F.col("touches") == 2) & (F.col("distinct") == 2)
    cut = F.when(loop & (F.col("id") == F.col("last")), F.col("id")).otherwise(F.col("chain"))
    out = out.select("id", cut.alias("chain"), F.col("tips").isNull().alias("closed"))
    return out.select("id", F.min("id").over(Window.partitionBy("chain")).alias("chain"), "closed")


def split_by_length(rows: DataFrame, way: str, place: str, length: str, most: float) -> DataFrame:
    """rows with `part`: a new part starts where the running length would pass `most`. The sum starts again at each cut, so it is folded over the way's
    ordered rows; a way is small, unlike the table."""
    item = F.struct(F.col(place).alias("place"), F.col(length).cast("double").alias("length"))
    packed = rows.groupBy(way).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    start = F.struct(F.lit(0).alias("part"), F.lit(0.0).alias("run"), F.array().cast("array<int>").alias("parts"))

    def step(state, x):
        over = (state["run"] > 0) & (state["run"] + x["length"] > most)
        part = state["part"] + over.cast("int")
        run = F.when(over, x["length"]).otherwise(state["run"] + x["length"])
        return F.struct(part.alias("part"), run.alias("run"), F.concat(state["parts"], F.array(part)).alias("parts"))

    parts = F.aggregate("_items", start, step, lambda s: s["parts"])
    each = packed.select(way, F.explode(F.arrays_zip(F.col("_items"), parts.alias("part"))).alias("_z"))
    return each.select(way, F.col("_z._items.place").alias(place), F.col("_z._items.length").alias(length), F.col("_z.part").alias("part"))


def nearest_two(pairs: DataFrame, margin: float) -> DataFrame:
    """pairs(a, b, distance) to (a, b, distance, status): the nearest b of each a, unless the second is less than `margin` farther (ambiguous); of several that
    claim the same b, the nearest keeps it (others: taken)."""
    order = Window.partitionBy("a").orderBy("distance", "b")
    both = pairs.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy("a").agg(F.min_by("b", "_r").alias("b"), F.min("distance").alias("distance"), F.max("distance").alias("_second"), F.count("*").alias("_n"))
    clear = both.withColumn("_clear", (F.col("_n") == 1) | (F.col("_second") - F.col("distance") >= margin))
    claims = clear.where("_clear").groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("_winner"))
    joined = clear.join(claims, "b", "left")
    status = F.when(~F.col("_clear"), "ambiguous").when(F.col("_winner") == F.col("a"), "matched").otherwise("taken")
    return joined.select("a", "b", "distance", status.alias("status"))


def snap_pairs(ods: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """ods(od, a, z) with nodes for both ends in one component: starts(a, node, component, distance) and ends(z, node, component, distance).

    Two nodes a component are kept at each end; the pair of distinct nodes with the least sum of distances wins, then the least larger distance, component, nodes.
    """

    def two(near: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key, "component").orderBy("distance", "node")
        return near.withColumn("_r", F.row_number().over(order)).where("_r <= 2").select(key, "component", F.col("node").alias(f"{key}_node"), F.col("distance").alias(f"{key}_distance"))

    met = ods.join(two(starts, "a"), "a").join(two(ends, "z"), ["z", "component"]).where("a_node <> z_node")
    both = F.struct((F.col("a_distance") + F.col("z_distance")).alias("sum"), F.greatest("a_distance", "z_distance").alias("most"), "component", "a_node", "z_node")
    return met.groupBy("od").agg(F.min(both).alias("_best")).select("od", "_best.component", "_best.a_node", "_best.z_node", F.col("_best.sum").alias("distance"))


def near_segments(points: DataFrame, lines: DataFrame, radius: float, size: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Pairs of points(a, ax, ay) and lines(b, x1, y1, x2, y2) at most `radius` apart, with distance and the line's bearing in degrees: (a, b, distance, bearing), and the columns of `by`, in
    which they agree.

    An equi-join on grid cells of the radius, or of `size`: a line is in all cells that its box, grown by the radius, touches.
    """
    by = by or []
    cell = lambda c: F.floor(c / (size or radius))
    across = F.sequence(cell(F.least("x1", "x2") - radius), cell(F.greatest("x1", "x2") + radius))
    up = F.sequence(cell(F.least("y1", "y2") - radius), cell(F.greatest("y1", "y2") + radius))
    lines = lines.select("*", F.explode(across).alias("_cx")).select("*", F.explode(up).alias("_cy"))
    met = points.withColumns({"_cx": cell(F.col("ax")), "_cy": cell(F.col("ay"))}).join(lines, ["_cx", "_cy", *by])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("ax") - F.col("x1")) * dx + (F.col("ay") - F.col("y1")) * dy) / size))).otherwise(0.0)
    away = F.sqrt((F.col("ax") - F.col("x1") - along * dx) ** 2 + (F.col("ay") - F.col("y1") - along * dy) ** 2)
    bearing = F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))
    return met.select("a", "b", *by, away.alias("distance"), bearing.alias("bearing")).where(F.col("distance") <= radius)


def nearest_segments(points: DataFrame, lines: DataFrame, radius: float, fits: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Those pairs of near_segments(points, lines, radius, by=by) that fit (all columns of points and pairs may be asked) and may be the nearest of their point (in its `by`), with the points' columns; see
    relational.nearest_pairs. The first reach is where about 8 lines are to be expected, its cells are no smaller than a quarter of the lines' extent."""
    by = by or []
    x, y = (F.abs(F.col(f"{c}2") - F.col(f"{c}1")) for c in "xy")
    s = lines.agg(F.count("*").alias("n"), F.avg(F.greatest(x, y)).alias("m"), (F.max("x1") - F.min("x1")).alias("w"), (F.max("y1") - F.min("y1")).alias("h"), F.count_distinct(*by).alias("kinds") if by else F.lit(1).alias("kinds")).first()
    first = radius
    if s.n and s.w * s.h > 0:
        room = 8 * max(s.kinds, 1) * s.w * s.h / s.n  # (2 m + pi r) r = room
        first = (math.sqrt(s.m**2 + math.pi * room) - s.m) / math.pi

    def pairs(p: DataFrame, r: float) -> DataFrame:
        met = near_segments(p.select("a", "ax", "ay", *by), lines, r, max(r, s.m / 4 if s.m else 0.0), by)
        more = [c for c in p.columns if c not in ("ax", "ay", *by)]
        met = met.join(p.select(*more), "a") if len(more) > 1 else met
        return met if fits is None else met.where(fits)

    return nearest_pairs(points, pairs, ["a", *by], 1, max(first, radius / 1024) if 2 * first < radius else radius, radius)


def gravity(pairs: DataFrame, scale: float) -> DataFrame:
    """pairs(origin, destination, supply, arrivals, distance) with trips: each destination's arrivals shared by supply * exp(-distance / scale).

    The denominators are summed before they are joined on, so a destination that half of all pairs share stays spread.
    """
    weighed = pairs.withColumn("_w", F.col("supply") * F.exp(-F.col("distance") / scale))
    sums = weighed.groupBy("destination").agg(F.sum("_w").alias("_sum"))
    return weighed.join(sums, "destination").withColumn("trips", F.when(F.col("_sum") > 0, F.col("arrivals") * F.col("_w") / F.col("_sum")).otherwise(0.0)).drop("_w", "_sum")


def robust_scale(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """rows with each column scaled to 0..1 between its group's 5th and 95th percentile, 0.5 where these are equal. The percentiles are aggregated first and joined."""
    ends = rows.groupBy(by).agg(*(F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias(f"_{c}") for c in columns))
    joined = rows.join(ends, by)
    for c in columns:
        low, high = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        joined = joined.withColumn(c, F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - low) / (high - low)))).otherwise(0.5)).drop(f"_{c}")
    return joined


def apply_treatments(edges: DataFrame, treatments: DataFrame) -> DataFrame:
    """edges(edge, facility, ...) with treated facilities of treatments(edge, treatment) put in; raises where two treatments of one edge differ."""
    one = treatments.groupBy("edge").agg(F.min("treatment").alias("_new"), F.max("treatment").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("conflicting treatments on edge "), F.col("edge").cast("string"))).cast("string")
    put = F.when(F.col("_new") != F.col("_other"), clash).otherwise(F.coalesce("_new", "facility"))
    return edges.join(one, "edge", "left").withColumn("facility", put).drop("_new", "_other")


def chain_lines(edges: DataFrame) -> DataFrame:
    """(chain, line): edges(chain, place, coordinates array<struct<x, y>>, reversed) end to end in their order, turned round where they lie the other way, without the joints that two share.
    A chain's coordinates are one row, as a line is."""
    way = F.when(F.col("reversed"), F.reverse("coordinates")).otherwise(F.col("coordinates"))
    packed = edges.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("place", way.alias("c")))).alias("parts"))
    points = F.flatten(F.transform("parts", lambda p: p["c"]))
    return packed.select("chain", points.alias("points")).select("chain", F.filter("points", lambda p, i: (i == 0) | (p != F.get(F.col("points"), i - 1))).alias("line"))
