"""What elements of a map extract stand for: ways with their places, and areas put together from relations."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetworth.operators.graph import _save

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def stops(elements: DataFrame) -> DataFrame:
    """(way, place, node) of elements(kind, id, refs)."""
    return elements.where("kind = 'way'").select(F.col("id").alias("way"), F.posexplode("refs").alias("place", "node"))


def placed_stops(elements: DataFrame) -> DataFrame:
    """stops with x (lon) and y (lat); null where the extract lacks the node."""
    nodes = elements.where("kind = 'node'").select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return stops(elements).join(nodes, "node", "left").select("way", "place", "node", "x", "y")


def closed_trails(lines: list[list[tuple]]) -> list[list[tuple]] | None:
    """Rings out of lines of (node, x, y) joined at equal end nodes, in either direction; None where an end stays loose.

    Where more than two lines meet, any closed trails over all lines have the same inside by the even-odd rule, so it doesn't matter which are taken.
    """
    at = defaultdict(set)
    for i, line in enumerate(lines):
        at[line[0][0]].add(i)
        at[line[-1][0]].add(i)
    rings, left = [], dict(enumerate(lines))
    for start in range(len(lines)):
        if start not in left:
            continue
        ring = list(left.pop(start))
        while ring[0][0] != ring[-1][0]:
            following = min((i for i in at[ring[-1][0]] if i in left), default=None)
            if following is None:
                return None
            line = left.pop(following)
            ring += line[1:] if line[0][0] == ring[-1][0] else line[-2::-1]
        rings.append(ring[:-1])
    return rings


def _ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rings and status of each row's lines."""
    for batch in batches:
        rings, states = [], []
        for lines, whole in zip(batch.column("lines").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            lines = [[(v["node"], v["x"], v["y"]) for v in line["stops"]] for line in lines]
            found = closed_trails([line for line in lines if len(line) > 1]) if whole else None
            rings.append(None if found is None else [[{"x": x, "y": y} for _, x, y in ring] for ring in found])
            states.append("incomplete" if not whole else "open" if found is None else "ok" if found else "empty")
        yield pa.record_batch([batch.column("id"), pa.array(rings, pa.list_(pa.list_(_POINT))), pa.array(states, pa.string())], names=["id", "rings", "status"])


def assembled_areas(elements: DataFrame, kinds: tuple[str, ...] = ("multipolygon", "boundary")) -> DataFrame:
    """(id, tags, rings, status) of each relation whose tag `type` is one of kinds, its rings put together from its ways, each way once however often it is named.

    A place is inside where it lies in an odd number of rings, so the roles aren't needed. status: ok; open (ends that meet no other, rings null); incomplete (a way or a node is not in the extract, rings null);
    empty (no ways). One relation's ways make one row; the format bounds their number, and no group of relations is gathered. elements must name each element once; they are saved first, so that
    a file's blocks are unpacked once and not for each join.
    """
    elements = _save(elements)
    relations = elements.where((F.col("kind") == "relation") & F.col("tags")["type"].isin(*kinds))
    named = relations.select("id", F.explode(F.array_distinct(F.transform(F.filter("members", lambda m: m["kind"] == "way"), lambda m: m["ref"]))).alias("way"))
    wanted = named.select("way").distinct()
    mine = elements.where("kind <> 'way'").unionByName(elements.where("kind = 'way'").join(wanted, elements["id"] == wanted["way"], "left_semi"))
    lines = placed_stops(mine).groupBy("way").agg(F.sort_array(F.collect_list(F.struct("place", "node", "x", "y"))).alias("stops"))
    whole = F.col("stops").isNotNull() & ~F.exists(F.coalesce("stops", F.array()), lambda v: v["x"].isNull() | v["y"].isNull())
    line = F.struct("way", F.coalesce(F.col("stops"), F.array().cast(lines.schema["stops"].dataType)).alias("stops"))
    gathered = named.join(lines, "way", "left").groupBy("id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.min(whole).alias("whole"))
    rings = gathered.mapInArrow(_ringed, "id bigint, rings array<array<struct<x:double,y:double>>>, status string")
    return relations.select("id", "tags").join(rings, "id", "left").select("id", "tags", "rings", F.coalesce("status", F.lit("empty")).alias("status"))


def area_places(areas: DataFrame, destination: Column) -> DataFrame:
    """(id, category, roles, x, y) of measured areas(id, tags, point) that `destination`, a struct(category, roles) of their tags, names, at their interior point; areas without one are left out."""
    return areas.withColumn("_d", destination).where("_d is not null and point is not null").select("id", "_d.category", "_d.roles", "point.x", "point.y")
