"""Hard negatives against all inner products, with ties, nulls, repeated rows, huge numbers and many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetworth.llm.hard_negatives import Tree, hard_negatives, interval, leaf_pairs

SCHEMA = "vec_id long, embedding array<double>, label int, part string, block int"


def brute(rows, anchor, positives, negatives, percent):
    ok = [(i, tuple(int(v) for v in np.floor(np.array(x, float) * 256)), y) for i, x, y in rows if i is not None and y is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for i, x, y in sorted({r for r in ok if anchor(r[0])}):
        scored = sorted((-sum(a * b for a, b in zip(x, z, strict=True)), j, w) for j, z, w in ok if j != i and len(z) == len(x))
        for s, j, w in [r for r in scored if r[2] == y][:positives]:
            p = -s
            fit = [(-t, n) for t, n, w in scored if w != y and percent[0] * p <= 100 * -t <= percent[1] * p]
            out += [(i, j, r + 1, n, p, t) for r, (t, n) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors(seed, n=400, d=12, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * scale
    rows = [(i, (centres[i % 6] + rng.normal(size=d) * scale * 0.3).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[i][1], (rows[i][2] + i % 2) % 4) for i in range(0, 60, 3)]
    rows += [(2000, None, 1), (2010, [], 1), (2020, [None] * d, 1), (2030, [float("nan")] * d, 1), (2040, [float("inf")] + [0.0] * (d - 1), 1), (2050, rows[0][1], None), (2060, [0.0] * d, 2), (None, rows[1][1], 1)]
    rows += [(2070, rows[7][1][:5], 1), (2080, rows[8][1][:5], 1), (2090, rows[8][1][:5], 2), rows[5], rows[10], rows[10]]
    return rows


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(3)
    found = hard_negatives(frame, F.col("vec_id") % 10 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("options", [{"part_rows": 50, "leaf": 4}, {"anchor_mb": 0, "part_rows": 40}, {"positives": 2, "negatives": 3, "percent": (50, 95)}])
def test_same_as_all_products(spark, options):
    rows = vectors(len(options))
    want = brute(rows, lambda i: i % 10 == 0, options.get("positives", 5), options.get("negatives", 5), options.get("percent", (80, 100)))
    assert want and run(spark, rows, **options) == want


def test_huge_numbers(spark):
    """Products beyond 53 bits are decided on whole numbers."""
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(2**20, 2**20 + 40, 3)], i % 3) for i in range(60)]
    want = brute(rows, lambda i: i % 10 == 0, 5, 5, (80, 100))
    assert want and run(spark, rows) == want


def test_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(10, [1.0], 1), (20, [1.0], 2)]) == []


def test_intervals_hold():
    rng = np.random.default_rng(0)
    near = lambda n: rng.normal(size=(n, 7)) * 20 + 150 * rng.choice([-1, 1], (n, 1))
    a, b = Tree(near(90), 8), Tree(near(130), 8)
    products = a.x @ b.x.T
    i, j = (m.ravel() for m in np.meshgrid(range(len(a.start)), range(len(b.start))))
    least, most = interval(a, i, b, j)
    for u, v, low, high in zip(i, j, least, most, strict=True):
        block = products[a.start[u] : a.end[u], b.start[v] : b.end[v]]
        assert low <= block.min() and block.max() <= high
    low, high = np.full(90, 160_000), np.full(90, 170_000)
    kept = set(zip(*(x.tolist() for x in leaf_pairs(a, b, low, high)), strict=True))
    for u in np.flatnonzero(a.leaf):
        for v in np.flatnonzero(b.leaf):
            block = products[a.start[u] : a.end[u], b.start[v] : b.end[v]]
            assert (u, v) in kept or not ((block >= 160_000) & (block <= 170_000)).any()
    assert len(kept) < a.leaf.sum() * b.leaf.sum()
