"""Raster files put together by hand in all the layouts that are read, and values at and around points against plain loops."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetworth.operators import rasters as R
from streetworth.sources import rasters as S

PLACE = [(33550, "d", (10.0, 5.0, 0.0)), (33922, "d", (1.0, 2.0, 0.0, 110.0, 490.0, 0.0))]  # upper left corner at (100, 500)
CODES = {"H": 3, "I": 4, "d": 12, "Q": 16, "c": 2}


def tagged(tags, chunks, order="<", big=False):
    """A file of one directory behind its chunks; tags 273 and 324 get the chunks' places."""
    head = 16 if big else 8
    starts = np.cumsum([head, *map(len, chunks)])
    tags = sorted([*tags, *PLACE])
    unit, inline = ("Q", 8) if big else ("I", 4)
    at = int(starts[-1])
    behind = at + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    rows, extra = b"", b""
    for tag, kind, values in tags:
        values = [int(s) for s in starts[:-1]] if tag in (273, 324) else values
        body = values if kind == "c" else struct.pack(f"{order}{len(values)}{kind}", *values)
        held = body.ljust(inline, b"\0") if len(body) <= inline else struct.pack(order + unit, behind + len(extra))
        extra += body if len(body) > inline else b""
        rows += struct.pack(order + "HH" + unit, tag, CODES[kind], len(values)) + held
    mark = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return mark + b"".join(chunks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + rows + b"\0" * inline + extra


def load(spark, path, **options):
    spark.dataSource.register(S.RasterTiles)
    return spark.read.format("raster_tiles").options(**options).load(str(path))


def whole(rows, height, width):
    out = np.full((height, width), np.nan)
    for r in rows:
        i, j = round((500 - r.y) / 5), round((r.x - 100) / 10)
        out[i : i + r.height, j : j + r.width] = np.array(r["values"], float).reshape(r.height, r.width)
    return out


def test_layouts_put_together_by_hand(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (7, 5)).astype(float)
    v[3, 3] = -99
    want = np.where(v == -99, np.nan, v)
    base = [(256, "H", (5,)), (257, "H", (7,)), (42113, "c", b"-99\0")]
    strips = [v[i : i + 3] for i in range(0, 7, 3)]
    files = {"strips": tagged([*base, (258, "H", (16,)), (339, "H", (2,)), (273, "I", (0,) * 3), (278, "H", (3,)), (279, "I", [s.size * 2 for s in strips])], [s.astype(">i2").tobytes() for s in strips], ">")}
    padded = np.full((16, 16), 77.0)
    padded[:7, :5] = v
    square = [*base, (322, "H", (16,)), (323, "H", (16,)), (324, "Q", (0,))]
    diffed = np.diff(padded.astype("<i4"), axis=1, prepend=0).astype("<i4").tobytes()
    files["differences"] = tagged([*square, (258, "H", (32,)), (339, "H", (2,)), (259, "H", (8,)), (317, "H", (2,)), (325, "Q", (len(zlib.compress(diffed)),))], [zlib.compress(diffed)], big=True)
    split = padded.astype(">f4").view(np.uint8).reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
    split = np.diff(split.astype(int), axis=1, prepend=0).astype(np.uint8).tobytes()
    files["floats"] = tagged([*square[:-1], (324, "I", (0,)), (258, "H", (32,)), (339, "H", (3,)), (259, "H", (32946,)), (317, "H", (3,)), (325, "I", (len(zlib.compress(split)),))], [zlib.compress(split)])
    two = np.stack([padded, padded[::-1]], 2).astype("<f8").tobytes()
    files["chunky"] = tagged([*square[:-1], (324, "I", (0,)), (258, "H", (64, 64)), (277, "H", (2,)), (339, "H", (3, 3)), (325, "I", (len(two),))], [two])
    planes = [np.zeros((16, 16)).astype("<f8").tobytes(), padded.astype("<f8").tobytes()]
    files["planar"] = tagged([*square[:-1], (324, "I", (0, 0)), (258, "H", (64, 64)), (277, "H", (2,)), (284, "H", (2,)), (339, "H", (3, 3)), (325, "I", tuple(map(len, planes)))], planes)
    for name, content in files.items():
        (tmp_path / f"{name}.tif").write_bytes(content)
        rows = load(spark, tmp_path / f"{name}.tif", band=2 if name == "planar" else 1).collect()
        np.testing.assert_array_equal(whole(rows, 7, 5), want, name)
    assert load(spark, tmp_path / "strips.tif", bytes=1).rdd.getNumPartitions() == 3
    for name, content, words in (("text", b"no image at all.", "not a tagged image"), ("packed", tagged([*base, (259, "H", (5,)), (273, "I", (0,)), (279, "I", (1,))], [b"x"]), "compression 5")):
        (tmp_path / f"{name}.tif").write_bytes(content)
        with pytest.raises(Exception, match=words):
            load(spark, tmp_path / f"{name}.tif").collect()
    with pytest.raises(Exception, match="no band 2"):
        load(spark, tmp_path / "strips.tif", band=2).collect()


def test_what_is_written_comes_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = np.where(rng.random((40, 23)) < 0.2, np.nan, rng.random((40, 23)))
    spark.dataSource.register(S.RasterTiles)
    rows = spark.createDataFrame([("", 0, 100.0, 500.0, 10.0, 5.0, 23, 40, [None if np.isnan(x) else float(x) for x in v.ravel()])], S.SCHEMA)
    path = str(tmp_path / "out")
    rows.write.format("raster_tiles").option("tile", 16).mode("append").save(path)
    back = load(spark, path)
    assert back.count() == 6 and back.where("exists(values, x -> isnan(x))").count() == 0
    np.testing.assert_array_equal(whole(back.collect(), 40, 23), v)
    with pytest.raises(Exception, match="new folders"):
        rows.write.format("raster_tiles").mode("append").save(path)
    rows.where("false").write.format("raster_tiles").mode("append").save(str(tmp_path / "empty"))
    assert load(spark, tmp_path / "empty").count() == 0


def test_values_at_and_around_points_against_loops(spark):
    rng = random.Random(8)
    tiles = []  # two files that overlap, the second with smaller cells
    for name, x, y, dx, dy, n in (("a", 0.0, 100.0, 10.0, 5.0, 2), ("b", 15.0, 90.0, 3.0, 4.0, 3)):
        for t in range(n * n):
            w, h = 4, 5
            values = [None if rng.random() < 0.3 else rng.random() for _ in range(w * h)]
            tiles.append((name, t, x + t % n * w * dx, y - t // n * h * dy, dx, dy, w, h, values))
    points = [(i, rng.uniform(-20, 110), rng.uniform(20, 120)) for i in range(300)] + [(300, 0.0, 100.0), (301, 80.0, 60.0), (302, 10.0, 95.0), (303, None, 1.0), (304, float("nan"), 1.0)]
    at, near = {}, {}
    for i, px, py in points:
        at[i], near[i] = None, []
        if px is None or px != px:
            continue
        for _, _, x, y, dx, dy, w, h, values in tiles:
            col, row = int((px - x) // dx), int((y - py) // dy)
            if at[i] is None and 0 <= col < w and 0 <= row < h:
                at[i] = values[row * w + col]
            near[i] += [values[r * w + c] for r in range(h) for c in range(w) if (x + (c + 0.5) * dx - px) ** 2 + (y - (r + 0.5) * dy - py) ** 2 <= 15.0**2 and values[r * w + c] is not None]
    p, t = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(tiles, S.SCHEMA)
    assert sum(v is not None for v in at.values()) > 50
    for span in (7.0, 500.0):
        assert {r.id: r.value for r in R.sampled(p, t, span).collect()} == at
        got = {r.id: sorted(r.v) for r in R.around(p, t, span, 15.0).groupBy("id").agg(F.collect_list("value").alias("v")).collect()}
        assert got == {i: sorted(v) for i, v in near.items() if v}
    assert R.sampled(p, t.where("false"), 7.0).where("value is not null").count() == 0 and R.around(p.where("false"), t, 7.0, 15.0).count() == 0
