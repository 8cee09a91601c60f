"""Areas that polygons share, against sample points, closed forms and each other."""

import math
import random

import numpy as np
import pytest

from streetworth.operators import areas as A

SCHEMA = "id long, rings array<array<struct<x:double,y:double>>>"


def rings(*each):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in each]


def star(rng, cx, cy, size, n):
    return [(cx + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def inside(rings_, x, y):
    odd = np.zeros(len(x), bool)
    for r in rings_:
        for p, q in zip(r, r[1:] + r[:1], strict=True):
            if p["y"] != q["y"]:
                odd ^= ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]))
    return odd


@pytest.mark.parametrize("seed", range(6))
def test_overlap_of_stars(seed):
    rng = random.Random(seed)
    a = rings(star(rng, 0, 0, 10, 9), star(rng, 0, 0, 3, 5))
    b = rings(star(rng, rng.uniform(-6, 6), 2, 9, 11))
    points = np.random.default_rng(seed).uniform(-12, 16, (400_000, 2))
    both = inside(a, *points.T) & inside(b, *points.T)
    got = A.overlap(A.edges(a), A.edges(b))
    assert got == pytest.approx(both.mean() * 28 * 28, abs=0.6) and got == pytest.approx(A.overlap(A.edges(b), A.edges(a)))
    for shape in (a, b):
        x, y = A.interior(A.edges(shape))
        assert inside(shape, np.array([x]), np.array([y])).all() and A.covers(A.edges(shape), x, y)


def test_degenerate():
    square, bow = rings([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]), rings([(0, 0), (2, 2), (2, 0), (0, 2)])
    area = lambda p, q: A.overlap(A.edges(p), A.edges(q))
    assert area(square, square) == 4 and area(bow, bow) == pytest.approx(2) and area(square, bow) == pytest.approx(2)
    assert area(square, rings([(2, 0), (4, 0), (4, 2), (2, 2)])) == 0 and area(square, rings([(0, 0), (1, 1), (2, 2)])) == 0
    assert A.interior(A.edges(rings([(0, 0), (1, 1), (2, 2)]))) is None and A.interior(A.edges(None)) is None and A.interior(A.edges(rings([(0, 0)]))) is None
    assert A.covers(A.edges(square), 2, 1) and A.covers(A.edges(square), 0, 0) and not A.covers(A.edges(square), 2.001, 1)


def test_tables(spark):
    rng = random.Random(9)
    left = [(i, rings(star(rng, rng.uniform(0, 60), rng.uniform(-30, 30), 8, 7))) for i in range(25)] + [(90, None), (91, []), (92, rings([(1, 1)]))]
    right = [(i, rings(star(rng, rng.uniform(0, 60), rng.uniform(-30, 30), 14, 9), star(rng, 30, 0, 5, 6))) for i in range(12)]
    a, b = (spark.createDataFrame(t, SCHEMA) for t in (left, right))
    want = {(i, j): s for i, p in left for j, q in right if (s := A.overlap(A.edges(p), A.edges(q))) > 0}
    for cell in (3.0, 50.0):
        got = [(r["a"], r["b"], r["area"]) for r in A.overlaps(a, b, cell).collect()]
        assert len(got) == len(want) and {(i, j): s for i, j, s in got} == pytest.approx(want)


def test_assignment(spark):
    """A point on the common border of two zones goes by area; equal areas are ambiguous; holes belong to nobody."""
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    zones = [(1, rings(box(0, 0, 10, 10), box(2, 2, 4, 4))), (2, rings(box(10, 0, 20, 10)))]
    areas = [(1, rings(box(5, 5, 6, 6))), (2, rings(box(9, 5, 11, 6))), (3, rings([(9, 2), (11, 2), (11, 3), (12, 4), (8, 4), (9, 3)])), (4, rings(box(2.5, 2.5, 3.5, 3.5))), (5, rings(box(50, 50, 51, 51))), (6, rings([(0, 0), (1, 1)])), (7, rings([(9, 1), (11, 1), (11, 2), (9, 2)], [(9, 3), (9.5, 3), (9.5, 3.5), (9, 3.5)]))]
    found = {r["id"]: (r["zone"], r["status"]) for r in A.assigned_zones(spark.createDataFrame(areas, SCHEMA), spark.createDataFrame(zones, SCHEMA), 4.0).collect()}
    assert found[1] == (1, "assigned") and found[2] == (None, "ambiguous") and found[3] == (None, "ambiguous")
    assert found[4] == (None, "missing") and found[5] == (None, "missing") and found[6] == (None, "no_area")
    tilted = [(8, rings([(9, 5), (11, 5), (11, 7), (8, 9), (9, 7)]))]
    (one,) = A.assigned_zones(spark.createDataFrame(tilted, SCHEMA), spark.createDataFrame(zones, SCHEMA), 4.0).collect()
    assert one["zone"] == 1


def test_equal_sections_go_to_the_left_also_where_places_are_rounded():
    for x in range(0, 11500, 500):
        for w in (160, 240, 320, 400):
            box = lambda v: [((x + i * v) / 1000, (500 + j * v) / 1000) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]  # noqa: B023, E731
            e = A.edges([[{"x": i, "y": j} for i, j in box(v)] for v in (w, w / 4)])
            assert abs(A.interior(e)[0] * 1000 - (x - w * 5 / 8)) < 1e-6
