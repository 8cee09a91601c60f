"""Hexagonal cells of the plane as Columns: a cell is (q, r) in axial coordinates, its hexagon has a corner at the top and edges of length `size`."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps to the six neighbours.
STEPS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def hexagon(x: Column, y: Column, size: float) -> Column:
    """struct<q, r> (long) of the cell whose centre is nearest: rounded in all three axes, and the axis that was moved most follows from the others."""
    q, r = (x * math.sqrt(3) / 3 - y / 3) / size, y * 2 / 3 / size
    near = lambda c: F.floor(c + 0.5)
    i, j, k = near(q), near(r), near(-q - r)
    dq, dr, ds = F.abs(i - q), F.abs(j - r), F.abs(k + q + r)
    first = (dq > dr) & (dq > ds)
    return F.struct(F.when(first, -j - k).otherwise(i).alias("q"), F.when(~first & (dr > ds), -i - k).otherwise(j).alias("r"))


def centre(q: Column, r: Column, size: float) -> Column:
    """struct<x, y>, the middle of a cell."""
    return F.struct((size * math.sqrt(3) * (q + r / 2)).alias("x"), (size * 1.5 * r).alias("y"))


def neighbours(q: Column, r: Column) -> Column:
    """array<struct<q, r>> of the six cells around a cell."""
    return F.array(*(F.struct((q + a).alias("q"), (r + b).alias("r")) for a, b in STEPS))
