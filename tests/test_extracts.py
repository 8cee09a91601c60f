"""Binary map extracts against elements put into bytes by hand, and areas of relations against shapes of known size."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetworth.operators import areas as A
from streetworth.operators import extracts as O
from streetworth.sources import extracts as E


def varint(n):
    out, n = b"", n % (1 << 64)
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zig(n):
    return varint(n << 1 if n >= 0 else -2 * n - 1)


def part(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def block(kind, raw, packed=True):
    blob = varint(2 << 3) + varint(len(raw)) + part(3, zlib.compress(raw)) if packed else part(1, raw)
    header = part(1, kind) + varint(3 << 3) + varint(len(blob))
    return len(header).to_bytes(4, "big") + header + blob


HEADER = block(b"OSMHeader", part(4, b"OsmSchema-V0.6") + part(4, b"DenseNodes"))


def load(spark, path, **options):
    spark.dataSource.register(E.MapExtract)
    return spark.read.format("map_extract").options(**options).load(str(path))


def test_packed_numbers_against_bytes_by_hand():
    rng = random.Random(3)
    values = [rng.choice((0, 1, -1, 127, 128, 2**31, -(2**31), 2**61, -(2**61))) + rng.randrange(-3, 4) for _ in range(500)]
    steps = np.diff(np.array(values, object), prepend=0)
    assert E._deltas(b"".join(zig(int(s)) for s in steps)).tolist() == values
    positive = [abs(v) for v in values]
    assert E._packed(np.array(positive)) == b"".join(map(varint, positive))
    assert E._unpacked(E._packed(np.array(positive))).tolist() == positive
    assert E._unpacked(b"").tolist() == [] and E._packed(np.array([-1])) == varint(-1)


def test_elements_of_a_file_put_together_by_hand(spark, tmp_path):
    strings = part(1, b"".join(part(1, s) for s in (b"", b"name", "Ōtara".encode(), b"outer", b"type")))
    plain = part(1, varint(1 << 3) + zig(-5) + part(2, varint(1)) + part(3, varint(2)) + varint(8 << 3) + zig(-100) + varint(9 << 3) + zig(3))
    dense = part(2, part(1, zig(7) + zig(-3)) + part(8, zig(10) + zig(-20)) + part(9, zig(1) + zig(1)) + part(10, varint(0) + varint(1) + varint(2) + varint(0)))
    way = part(3, varint(1 << 3) + varint(9) + part(8, zig(7) + zig(-3) + zig(3)))
    relation = part(4, varint(1 << 3) + varint(11) + part(2, varint(4)) + part(3, varint(3)) + part(8, varint(3) + varint(0)) + part(9, zig(9) + zig(-2)) + part(10, varint(1) + varint(0)))
    place = varint(17 << 3) + varint(1000) + varint(19 << 3) + varint(-5) + varint(20 << 3) + varint(2000)
    path = tmp_path / "a.pbf"
    path.write_bytes(HEADER + block(b"OSMData", strings + part(2, plain) + part(2, dense) + place) + block(b"Other", b"passed over") + block(b"OSMData", strings + part(2, way) + part(2, relation), packed=False))
    rows = {(r.kind, r.id): r for r in load(spark, path).collect()}
    assert set(rows) == {("node", -5), ("node", 7), ("node", 4), ("way", 9), ("relation", 11)}
    assert (rows["node", -5].lat, rows["node", -5].lon, rows["node", -5].tags) == (-100005 / 1e9, 5000 / 1e9, {"name": "Ōtara"})
    assert (rows["node", 7].tags, rows["node", 4].tags, rows["node", 4].lat, rows["node", 4].lon) == ({}, {"name": "Ōtara"}, -10005 / 1e9, 4000 / 1e9)
    assert (rows["way", 9].refs, rows["way", 9].tags, rows["way", 9].members, rows["way", 9].lat) == ([7, 4, 7], {}, None, None)
    assert [tuple(m) for m in rows["relation", 11].members] == [("way", 9, "outer"), ("node", 7, "")] and rows["relation", 11].tags == {"type": "outer"}
    assert {r.kind for r in load(spark, path, kinds="way").collect()} == {"way"}
    assert load(spark, path, bytes=1).rdd.getNumPartitions() == 2


def test_values_of_word_0_do_not_end_the_tags_of_a_node():
    strings = part(1, b"".join(part(1, s) for s in (b"", b"a", b"b")))
    dense = part(2, part(1, zig(1) + zig(1) + zig(1)) + part(8, zig(0) * 3) + part(9, zig(0) * 3) + part(10, bytes([1, 0, 2, 1, 0, 0, 2, 0, 0])))
    (batch,) = E.decoded(strings + part(2, dense), {"node"})
    assert [dict(r["tags"]) for r in batch.to_pylist()] == [{"a": "", "b": "a"}, {}, {"b": ""}]


def test_what_cannot_be_read_is_refused(spark, tmp_path):
    (tmp_path / "cut.pbf").write_bytes((HEADER + block(b"OSMData", b""))[:-1])
    (tmp_path / "feature.pbf").write_bytes(block(b"OSMHeader", part(4, b"HistoricalInformation")))
    (tmp_path / "text.pbf").write_bytes(b"<osm></osm>")
    for name, words in (("cut", "cut off"), ("feature", "HistoricalInformation"), ("text", "no block header")):
        with pytest.raises(Exception, match=words):
            load(spark, tmp_path / f"{name}.pbf").collect()
    with pytest.raises(Exception, match="unknown kinds"):
        load(spark, tmp_path / "cut.pbf", kinds="ways").collect()


def test_random_elements_come_back_and_folders_are_read_whole(spark, tmp_path):
    rng = random.Random(5)
    tags = lambda: {rng.choice("abc") * rng.randrange(1, 40): rng.choice(("", "é", "x" * 300)) for _ in range(rng.randrange(3))}
    rows = [("node", i * 10**9 - 5, rng.randrange(-9 * 10**8, 9 * 10**8) / 1e7, rng.randrange(-18 * 10**8, 18 * 10**8) / 1e7, None, None, tags()) for i in range(20_000)]
    rows += [("way", i, None, None, [rng.randrange(10**12) for _ in range(rng.randrange(6))], None, tags()) for i in range(300)]
    rows += [("relation", i, None, None, None, [(rng.choice(E.KINDS), rng.randrange(10**12), rng.choice(("", "outer"))) for _ in range(rng.randrange(4))], tags()) for i in range(300)]
    spark.dataSource.register(E.MapExtract)
    path = str(tmp_path / "out")
    spark.createDataFrame(rows, E.SCHEMA).repartition(3).write.format("map_extract").mode("append").save(path)
    back = load(spark, path)
    plain = lambda r: (*r[:5], None if r[5] is None else [tuple(m) for m in r[5]], r[6])
    assert sorted((plain(r) for r in back.collect()), key=lambda r: r[:2]) == sorted(rows, key=lambda r: r[:2])
    with pytest.raises(Exception, match="new folders"):
        back.limit(1).write.format("map_extract").mode("append").save(path)
    empty = str(tmp_path / "empty")
    back.where("false").write.format("map_extract").mode("append").save(empty)
    assert load(spark, empty).count() == 0
    with pytest.raises(Exception, match="without a place"):
        spark.createDataFrame([("node", 1, None, 1.0, None, None, None)], E.SCHEMA).write.format("map_extract").mode("append").save(str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").glob("part-*.pbf")]


def test_areas_of_touching_rings_loose_ends_and_gaps(spark):
    nodes = {n: (x, y) for n, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (8, 4), (8, 8), (4, 8)])}
    ways = {1: [0, 1, 2], 2: [0, 3, 2], 3: [2, 4, 5, 6, 2], 4: [2, 4, 5], 5: [5, 6, 2], 6: [0, 99, 1], 7: [3, 0]}
    relations = {1: [1, 2], 2: [1, 2, 3], 3: [5, 1, 4, 2], 4: [1], 5: [1, 6], 6: [1, 77], 7: [], 8: [1, 2, 2, 1]}
    rows = [("node", n, float(y), float(x), None, None, {}) for n, (x, y) in nodes.items()]
    rows += [("way", w, None, None, refs, None, {}) for w, refs in ways.items()]
    rows += [("relation", r, None, None, None, [("way", w, "") for w in ws] + [("node", 1, "label")], {"type": "multipolygon"}) for r, ws in relations.items()]
    rows += [("relation", 9, None, None, None, [("way", 1, "")], {"type": "route"}), ("relation", 10, None, None, None, None, {"type": "boundary"})]
    found = O.assembled_areas(spark.createDataFrame(rows, E.SCHEMA))
    sizes = A.measured(found.select("id", "rings")).select("id", "area")
    told = {r.id: (r.status, r.area) for r in found.join(sizes, "id").collect()}
    assert told == {1: ("ok", 16), 2: ("ok", 32), 3: ("ok", 32), 4: ("open", 0), 5: ("incomplete", 0), 6: ("incomplete", 0), 7: ("empty", 0), 8: ("ok", 16), 10: ("empty", 0)}
    assert O.assembled_areas(spark.createDataFrame([], E.SCHEMA)).count() == 0
    assert O.stops(spark.createDataFrame(rows, E.SCHEMA)).where("way = 3").orderBy("place").select(F.collect_list("node")).first()[0] == [2, 4, 5, 6, 2]
