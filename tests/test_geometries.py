"""Geometries in Parquet: bytes by hand, every kind there and back, and row groups that are skipped."""

import json
import random
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from streetworth.sources import geometries as G


def test_bytes_by_hand():
    p = {"x": 1.5, "y": -2.0}
    assert G.encoded(p, 0) == struct.pack("<BIdd", 1, 1, 1.5, -2.0)
    assert G.decoded(struct.pack(">BIdd", 0, 1, 1.5, -2.0)) == (p, 21)
    assert G.decoded(struct.pack("<BIddd", 1, 1001, 1.5, -2.0, 9.0))[0] == p
    assert G.decoded(struct.pack("<BIddd", 1, 0x80000001, 1.5, -2.0, 9.0))[0] == p
    assert G.decoded(struct.pack("<BIIddd", 1, 0xA0000001, 4326, 1.5, -2.0, 9.0))[0] == p
    assert G.decoded(struct.pack("<BIIdddddddd", 1, 3002, 2, 1.5, -2.0, 8, 8, 1.5, -2.0, 8, 8))[0] == [p, p]
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]
    assert G.decoded(G.encoded([ring], 2))[0] == [[*ring, ring[0]]] and G.decoded(G.encoded([[[*ring, ring[0]]], []], 3))[0] == [[[*ring, ring[0]]], []]
    with pytest.raises(ValueError, match="code 7"):
        G.decoded(struct.pack("<BII", 1, 7, 0))


@pytest.mark.parametrize("name", G.NAMES)
def test_every_kind_there_and_back(spark, tmp_path, name):
    rng = random.Random(name)
    point = lambda: (rng.uniform(-9, 9), rng.uniform(-9, 9))

    def ring():
        ps = [point() for _ in range(4)]
        return [*ps, ps[0]]

    make = {"Point": point, "LineString": lambda: [point() for _ in range(rng.randrange(4))], "Polygon": lambda: [ring() for _ in range(rng.randrange(3))], "MultiPolygon": lambda: [[ring()] for _ in range(rng.randrange(3))]}[name]
    rows = [(i, "é", None if i % 10 == 0 else make()) for i in range(500)]
    schema = StructType([StructField("id", LongType()), StructField("text", StringType()), StructField("shape", G.geometry_type(name))])
    path = str(tmp_path / "out")
    G.write_geometries(spark.createDataFrame(rows, schema), path, "shape", 3.0, 20)
    plain = lambda g: None if g is None else tuple(g) if hasattr(g, "x") else [plain(v) for v in g]
    assert sorted((r.id, r.text, plain(r["shape"])) for r in G.read_geometries(spark, path, name).drop("bbox").collect()) == rows
    file = next((tmp_path / "out").glob("part-*.parquet"))
    meta = json.loads(pq.read_schema(file).metadata[b"geo"])
    assert meta["primary_column"] == "shape" and meta["columns"]["shape"]["geometry_types"] == [name]

    def points(g):
        return [g] if isinstance(g, tuple) else [p for v in g or () for p in points(v)]

    met = lambda ps: bool(ps) and min(p[0] for p in ps) <= 4 and max(p[0] for p in ps) >= 2 and min(p[1] for p in ps) <= 4 and max(p[1] for p in ps) >= 2
    near = G.read_geometries(spark, path, name, (2, 2, 4, 4))
    assert {r.id for r in near.collect()} == {i for i, _, g in rows if met(points(g))}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # plans are cut off otherwise
    near = G.read_geometries(spark, path, name, (2, 2, 4, 4))
    assert "LessThanOrEqual(bbox.xmin,4.0)" in near._jdf.queryExecution().toString()


def test_what_has_no_geometries_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    (tmp_path / "none").mkdir()
    for name, words in (("plain", "no geometries"), ("none", "no files")):
        with pytest.raises(ValueError, match=words):
            G.read_geometries(spark, str(tmp_path / name), "Point")


@pytest.mark.parametrize("name", G.NAMES)
def test_features_of_every_kind(spark, tmp_path, name):
    ring = [[0.1234567, 0], [4, 0, 7], [4, 4], [0.1234567, 0]]
    given = {"Point": ring[0], "LineString": ring, "Polygon": [ring], "MultiPolygon": [[ring], []]}[name]
    feature = lambda n, g: {"type": "Feature", "properties": {"n": n}, "geometry": g and {"type": g[0], "coordinates": g[1]}}
    features = [feature(1, (name, given)), feature(2, None)]
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, features)))
    bad = feature(3, ("GeometryKind", given))
    (tmp_path / "bad.json").write_text(json.dumps({"type": "FeatureCollection", "features": [bad]}))
    one, lines = (G.read_shapes(spark, str(tmp_path / f), "n: bigint", name, by_line) for f, by_line in (("all.json", False), ("lines.json", True)))
    assert sorted(one.collect(), key=lambda r: r.n) == sorted(lines.collect(), key=lambda r: r.n) and one.where("n = 2").first().geometry is None
    flat = lambda g: [g.x, g.y] if hasattr(g, "x") else [flat(v) for v in g]
    cut = lambda g: g[:2] if g and not isinstance(g[0], list) else [cut(v) for v in g]
    assert flat(one.where("n = 1").first().geometry) == cut(given)
    back = one.where("n = 1").select(G.coordinates(one["geometry"], name, 6).alias("c")).first().c
    assert back == json.loads(json.dumps(cut(given)).replace("0.1234567", "0.123457"))
    with pytest.raises(Exception, match="a feature is a GeometryKind"):
        G.read_shapes(spark, str(tmp_path / "bad.json"), "n: bigint", name).collect()
