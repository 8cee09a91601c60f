"""Chains, splits, treatments and the greedy build order against small cases and brute force."""

import math
import random

import pytest

from streetworth.operators import network as N
from streetworth.operators import selection as S


def chains(spark, rows):
    found = N.chains(spark.createDataFrame(rows, "id string, u string, v string")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.chain, set()).add(r.id)
    return sorted(map(sorted, groups.values())), {r.closed for r in found}


def test_chains(spark):
    assert chains(spark, [("a", "1", "2"), ("b", "2", "3"), ("c", "2", "4")]) == ([["a"], ["b"], ["c"]], {False})
    assert chains(spark, [("a", "1", "2"), ("b", "1", "2"), ("t", "2", "3")]) == ([["a"], ["b"], ["t"]], {False})
    assert chains(spark, [("a", "1", "2"), ("b", "2", "3"), ("c", "3", "1")]) == ([["a", "b", "c"]], {True})
    assert chains(spark, [("a", "1", "2"), ("b", "2", "3"), ("c", "3", "4")]) == ([["a", "b", "c"]], {False})
    assert chains(spark, []) == ([], set())


def test_split(spark):
    rows = spark.createDataFrame([("w", 0, 60.0), ("w", 1, 60.0), ("w", 2, 40.0), ("x", 0, 500.0)], "way string, place int, length double")
    assert sorted((r.way, r.place, r.part) for r in N.split_by_length(rows, "way", "place", "length", 100.0).collect()) == [("w", 0, 0), ("w", 1, 1), ("w", 2, 1), ("x", 0, 0)]


def test_conflicting_treatments_raise(spark):
    edges = spark.createDataFrame([(1, "painted"), (2, "mixed_traffic")], "edge int, facility string")
    same = spark.createDataFrame([(1, "protected"), (1, "protected")], "edge int, treatment string")
    assert sorted(map(tuple, N.apply_treatments(edges, same).select("edge", "facility").collect())) == [(1, "protected"), (2, "mixed_traffic")]
    with pytest.raises(Exception, match="conflicting"):
        N.apply_treatments(edges, spark.createDataFrame([(1, "protected"), (1, "shared")], "edge int, treatment string")).collect()


def response(eligible, base, before, after, elasticity):
    if eligible <= 0 or after >= before:
        return 0.0
    s = max(1e-5, min(base / eligible, 1 - 1e-5))
    p = 1 / (1 + math.exp(-(math.log(s / (1 - s)) + elasticity * math.log(before / after))))
    return max(0.0, min(eligible * (p - base / eligible), eligible - base))


def test_greedy_sequence_is_the_brute_force_one(spark):
    rng = random.Random(3)
    names, theta, elasticity = "abcde", 0.05, 0.6
    paths = [(od, p, rng.uniform(20, 40), q) for od in range(12) for p, q in ((1, 0.6), (2, 0.4))]
    savings = [(od, p, c, rng.uniform(0.5, 4)) for od, p, _, _ in paths for c in names if rng.random() < 0.4]
    ods = [(od, 100.0 + od, 10.0 + od) for od in range(12)]
    costs = {c: 50.0 + 10 * i for i, c in enumerate(names)}
    by = {}
    for od, p, c, s in savings:
        by[od, p, c] = s
    who = {od: (e, b) for od, e, b in ods}

    def total(chosen):
        out = 0.0
        for od in range(12):
            mine = [r for r in paths if r[0] == od]
            before = sum(q * c for _, _, c, q in mine)
            mass = sum(q * math.exp(theta * sum(by.get((od, p, c), 0) for c in chosen)) for _, p, _, q in mine)
            out += response(*who[od], before, before - math.log(mass) / theta, elasticity)
        return out

    want, built, left = [], [], sum(costs.values()) * 0.6
    while True:
        gains = [(total([*built, c]) - total(built), c) for c in names if c not in built and costs[c] <= left]
        gains = [(g / costs[c], g, -costs[c], c) for g, c in gains if g > 1e-12]
        if not gains:
            break
        best = max(gains)
        built.append(best[3])
        left -= costs[best[3]]
        want.append((best[3], best[1]))
    got = S.greedy_sequence(
        spark.createDataFrame(savings, "od int, path int, candidate string, saving double"), spark.createDataFrame(paths, "od int, path int, cost double, probability double"),
        spark.createDataFrame(ods, "od int, eligible double, base double"), spark.createDataFrame(list(costs.items()), "candidate string, cost double"), theta, elasticity, 0.6,
    ).orderBy("step").collect()
    assert [r.candidate for r in got] == [c for c, _ in want]
    assert [r.marginal for r in got] == pytest.approx([g for _, g in want])
    assert got[-1].total == pytest.approx(total(built))
