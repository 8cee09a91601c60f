"""Queries that write tables as binary map extracts and read them back: all elements, and areas put together from ways."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.functions import tags as T
from streetworth.operators import areas as A
from streetworth.operators import extracts as O
from streetworth.operators.graph import _save, shared_dir
from streetworth.plans.fixtures import table
from streetworth.registry import query
from streetworth.sources.extracts import SCHEMA, MapExtract

_EMPTY = {"lat": "cast(null as double)", "lon": "cast(null as double)", "refs": "cast(null as array<bigint>)", "members": "cast(null as array<struct<kind:string,ref:bigint,role:string>>)", "tags": "cast(map() as map<string,string>)"}


def _elements(rows: DataFrame, kind: str) -> DataFrame:
    """rows(id, ...) with the columns of the schema that they lack."""
    for name, value in _EMPTY.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.expr(value))
    return rows.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "lat", "lon", "refs", "members", "tags")


def _through_extract(elements: DataFrame) -> DataFrame:
    spark = elements.sparkSession
    spark.dataSource.register(MapExtract)
    path = f"{shared_dir(spark)}/streetworth/extract-{uuid.uuid4().hex}"
    elements.write.format("map_extract").mode("append").save(path)
    return spark.read.format("map_extract").schema(SCHEMA).load(path)


@query("""WITH w AS (SELECT l_orderkey AS id, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS refs FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY 1),
m AS (SELECT o_custkey AS id, string_agg('way/' || o_orderkey || '/' || o_orderstatus, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1)
SELECT 'node' AS kind, p_partkey AS id, (p_partkey * 7919 % 10007 - 5000) / 1e4 AS lat, (p_partkey * 104729 % 10009 - 5000) / 1e4 AS lon, NULL AS refs, NULL AS members, CASE WHEN p_partkey % 3 = 0 THEN 'brand=' || p_brand || ',name=' || p_type ELSE '' END AS tags FROM part
UNION ALL SELECT 'way', o_orderkey, NULL, NULL, coalesce(refs, ''), NULL, 'priority=' || o_orderpriority FROM orders LEFT JOIN w ON id = o_orderkey
UNION ALL SELECT 'relation', c_custkey, NULL, NULL, NULL, coalesce(members, ''), 'segment=' || c_mktsegment FROM customer LEFT JOIN m ON id = c_custkey""")
def extract_elements(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nodes, orders as ways over them and customers as relations of their orders, through a binary extract."""
    p, o = table(spark, d, "part"), table(spark, d, "orders")
    k = F.col("p_partkey")
    tagged = F.when(k % 3 == 0, F.create_map(F.lit("name"), "p_type", F.lit("brand"), "p_brand")).otherwise(F.expr(_EMPTY["tags"]))
    nodes = p.select(k.alias("id"), ((k * 7919 % 10007 - 5000) / 1e4).alias("lat"), ((k * 104729 % 10009 - 5000) / 1e4).alias("lon"), tagged.alias("tags"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("l_partkey")).distinct()
    refs = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda v: v["l_partkey"]).alias("refs"))
    ways = o.join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.coalesce("refs", F.expr("cast(array() as array<bigint>)")).alias("refs"), F.create_map(F.lit("priority"), "o_orderpriority").alias("tags"))
    member = F.struct(F.lit("way").alias("kind"), F.col("o_orderkey").cast("long").alias("ref"), F.col("o_orderstatus").alias("role"))
    owned = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(member)).alias("members"))
    relations = table(spark, d, "customer").join(owned, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("members", F.expr("cast(array() as array<struct<kind:string,ref:bigint,role:string>>)")).alias("members"), F.create_map(F.lit("segment"), "c_mktsegment").alias("tags"))
    back = _through_extract(_elements(nodes, "node").unionByName(_elements(ways, "way")).unionByName(_elements(relations, "relation")))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return back.select(
        "kind", "id", "lat", "lon", joined("refs", lambda r: r.cast("string")).alias("refs"), joined("members", lambda m: F.concat_ws("/", m["kind"], m["ref"], m["role"])).alias("members"),
        joined(F.sort_array(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("tags"),
    )


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """A relation for each supplier: a square with a hole or a notch, its outer border in two ways of opposite senses. Some lack a way, some are open, some aren't areas."""
    s = F.col("s_suppkey").cast("long")
    rows = table(spark, d, "supplier").select(s.alias("k"), (s * 7919 % 23 * 500).alias("x"), (s * 104729 % 22 * 500).alias("y"), (160 + s % 4 * 80).alias("w"))
    x, y, w, k = F.col("x"), F.col("y"), F.col("w"), F.col("k")
    box = lambda v: [(x - v, y - v), (x + v, y - v), (x + v, y + v), (x - v, y + v)]
    notched = [(x - w, y - w), (x + w, y - w), (x + w, y), (x, y), (x, y + w), (x - w, y + w)]
    corners = lambda places: F.array(*(F.struct((px / 1000).alias("lon"), (py / 1000).alias("lat")) for px, py in places))
    places = rows.select(k, F.posexplode(F.when(k % 2 == 0, corners(box(w) + box(w / 4))).otherwise(corners(notched))).alias("n", "at"))
    nodes = places.select((F.col("k") * 10 + F.col("n")).alias("id"), "at.lat", "at.lon")
    node = lambda *ns: F.array(*(k * 10 + n for n in ns))
    way = lambda n, refs: F.struct((k * 10 + n).alias("id"), refs.alias("refs"))
    last = F.when(k % 2 == 0, node(2, 3, 0)).otherwise(node(2, 3, 4, 5, 0))
    second = F.reverse(F.when(k % 7 == 3, F.slice(last, 1, 2)).otherwise(last))
    ways = rows.select(F.inline(F.array(way(0, node(0, 1, 2)), way(1, second), way(2, F.when(k % 2 == 0, node(4, 5, 6, 7, 4)))))).where("refs is not null").where("id % 10 <> 1 or cast(id / 10 as bigint) % 11 <> 5")
    member = lambda n, role: F.struct(F.lit("way").alias("kind"), (k * 10 + n).alias("ref"), F.lit(role).alias("role"))
    outer = F.array(member(1, "outer"), member(0, "outer"), member(0, "outer"))
    tags = F.create_map(F.lit("type"), F.when(k % 13 == 6, "route").otherwise("multipolygon"), F.lit("amenity"), F.when(k % 3 == 0, "library").otherwise("bench"))
    relations = rows.select(k.alias("id"), F.when(k % 2 == 0, F.concat(outer, F.array(member(2, "inner")))).otherwise(outer).alias("members"), tags.alias("tags"))
    return _elements(nodes, "node").unionByName(_elements(ways, "way")).unionByName(_elements(relations, "relation"))


_LOTS = "lots AS (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS holed, s_suppkey * 7919 % 23 * 500e0 AS x, s_suppkey * 104729 % 22 * 500e0 AS y, 160e0 + s_suppkey % 4 * 80 AS w, CASE WHEN s_suppkey % 11 = 5 THEN 'incomplete' WHEN s_suppkey % 7 = 3 THEN 'open' ELSE 'ok' END AS status FROM supplier WHERE s_suppkey % 13 <> 6)"


@query(f"WITH {_LOTS} SELECT id, status, CASE WHEN status = 'ok' THEN round(4 * w * w - CASE WHEN holed THEN w * w / 4 ELSE w * w END, 3) END AS area, CASE WHEN status = 'ok' THEN CASE WHEN holed THEN 2 ELSE 1 END END AS n_rings FROM lots")
def extract_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas of a binary extract's relations, put together from ways of both senses, with those that can't be."""
    found = _save(O.assembled_areas(_through_extract(_shapes(spark, d))))
    sizes = A.measured(found.where("rings is not null").select("id", "rings"))
    return found.join(sizes.select("id", (F.round(F.col("area") * 1e6, 3)).alias("area")), "id", "left").select("id", "status", "area", F.size("rings").cast("long").alias("n_rings"))


@query(f"WITH {_LOTS} SELECT id, 'civic' AS category, round(CASE WHEN holed THEN x - w * 5 / 8 ELSE x END, 3) AS x, round(CASE WHEN holed THEN y ELSE y - w / 2 END, 3) AS y FROM lots WHERE status = 'ok' AND id % 3 = 0")
def extract_places(spark: SparkSession, d: str) -> DataFrame:
    """Areas that draw people, as points inside them."""
    found = _save(O.assembled_areas(_through_extract(_shapes(spark, d))))
    inside = found.select("id", "tags").join(A.measured(found.where("status = 'ok'").select("id", "rings")), "id")
    return O.area_places(inside, T.destination(F.col("tags"))).select("id", "category", F.round(F.col("x") * 1000, 3).alias("x"), F.round(F.col("y") * 1000, 3).alias("y"))
