"""Simplified borders: neighbours keep them in common, and points within the tolerance go."""

import random

import numpy as np
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from streetworth.operators import areas as A
from streetworth.operators import simplify as S
from streetworth.sources.geometries import geometry_type

SCHEMA = StructType([StructField("id", LongType()), StructField("rings", geometry_type("Polygon"))])


def area(ring):
    p = np.array(ring)
    return abs((p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum()) / 2


def got(spark, rows, tolerance):
    return {r.id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in S.simplified(spark.createDataFrame(rows, SCHEMA), tolerance).collect()}


def test_lines_against_a_plain_recursion():
    rng = random.Random(1)

    def away(p, a, b):
        d = b - a
        t = min(1, max(0, (p - a) @ d / (d @ d))) if d @ d else 0.0
        return float(np.hypot(*(p - a - t * d)))

    def plain(p, least, tolerance):
        far = [away(v, p[0], p[-1]) for v in p[1:-1]]
        if not far or max(far) <= least:
            return [p[0], p[-1]]
        k = far.index(max(far)) + 1
        return [*plain(p[: k + 1], tolerance, tolerance)[:-1], *plain(p[k:], tolerance, tolerance)]

    for _ in range(100):
        p = np.array([(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randrange(2, 30))])
        np.testing.assert_array_equal(S.thinned(p, 2.0), np.array(plain(list(p), 0.0, 2.0)))
    assert len(S.thinned(np.array([(0.0, 0), (1, 0), (2, 0), (9, 0)]), 1.0)) == 2


def test_random_mosaics_have_no_gaps(spark):
    rng = random.Random(6)
    n = 4
    side = {}  # wiggly lines between the corners of a grid, each read by both cells in opposite senses
    for i in range(n + 1):
        for j in range(n + 1):
            for k, (di, dj) in enumerate(((1, 0), (0, 1))):
                line = [(i * 100.0, j * 100.0)]
                for s in range(1, 20):
                    line.append((i * 100.0 + (s * 5.0 * di or rng.uniform(-9, 9)), j * 100.0 + (s * 5.0 * dj or rng.uniform(-9, 9))))
                side[i, j, k] = [*line, ((i + di) * 100.0, (j + dj) * 100.0)]
    rows = []
    for i in range(n):
        for j in range(n):
            ring = side[i, j, 0][:-1] + side[i + 1, j, 1][:-1] + side[i, j + 1, 0][:0:-1] + side[i, j, 1][:0:-1]
            turn = rng.randrange(len(ring))
            ring = ring[turn:] + ring[:turn]
            rows.append((i * n + j, [ring[:: rng.choice((1, -1))]]))
    island = [(40.0, 40.0), (50.0, 38.0), (60.0, 40.0), (61.0, 50.0), (60.0, 60.0), (40.0, 60.0)]
    rows[0][1].append(island)
    rows.append((99, [island[3:] + island[:3] + [island[3]]]))
    out = got(spark, rows, 4.0)
    edges = {}
    for rings in out.values():
        for ring in rings:
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + 1
    inner = [e for e, times in edges.items() if times == 1]
    outer = lambda p: min(p) < 10 or max(p) > n * 100 - 10
    assert set(edges.values()) == {1, 2} and all(outer(a) and outer(b) for a, b in inner)  # only the outer border has one side
    assert sum(len(r) for rings in out.values() for r in rings) < 0.8 * sum(len(r) for _, rings in rows for r in rings)
    assert set(out[99][0]) == set(out[0][1])
    corners = {(i * 100.0, j * 100.0) for i in range(n + 1) for j in range(n + 1)} - {(x, y) for x in (0.0, n * 100.0) for y in (0.0, n * 100.0)}
    assert corners <= {p for rings in out.values() for ring in rings for p in ring}


def test_odd_rings_and_two_pieces_between_the_same_junctions(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    flat = [(0.0, 0.0), (2.0, 0.5), (4.0, 0.0), (2.0, -0.5)]  # thinner than the tolerance, split in two by its long diagonal
    rows = [(1, [[*square, square[0]]]), (2, None), (3, []), (4, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), (5, [[(9.0, 9.0), (9.0, 9.0), None, (10.0, 9.0), (10.0, 10.0)]]), (6, [flat[:3]]), (7, [[flat[2], flat[3], flat[0]]])]
    out = got(spark, rows, 1.0)
    assert out[2] == out[3] == out[4] == [] and area(out[1][0]) == 16 and len(out[5][0]) == 3
    assert area(out[6][0]) == area(out[7][0]) == 1
    assert got(spark, [], 1.0) == {}
    assert A.measured(S.simplified(spark.createDataFrame(rows, SCHEMA), 1.0)).where("id = 1").first().area == 16
    assert isinstance(geometry_type("Polygon"), ArrayType)
