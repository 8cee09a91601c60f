"""Branch and bound over projects against enumeration, and on more projects than can be enumerated."""

import random
from itertools import combinations

import pytest

from streetworth.operators.bounded import bounded_investment


def case(seed, n, ods, most):
    rng = random.Random(seed)
    names = [f"p{i:02d}" for i in range(n)]
    capital = [(p, float(rng.randint(1, 9))) for p in names]
    columns = [(o, rng.sample([*names, "lost"], rng.randint(1, most))) for o in range(ods) for _ in range(rng.randint(1, 2))]
    weights = [(o, float(rng.randint(0, 5))) for o in range(ods)]
    return names, capital, columns, weights


def frames(spark, columns, weights, capital):
    return spark.createDataFrame(columns, "od long, projects array<string>"), spark.createDataFrame(weights, "od long, weight double"), spark.createDataFrame(capital, "project string, capital double")


def value(chosen, columns, weights):
    served = {o for o, need in columns if set(need) <= set(chosen)}
    return sum(w for o, w in weights if o in served), sum(w > 0 for o, w in weights if o in served)


@pytest.mark.parametrize("seed, budget, exclusive", [(1, 12.0, None), (2, 25.0, [["p00", "p03"], ["p01", "p02", "p05"]]), (3, 0.0, None), (4, 1000.0, None)])
def test_same_as_enumeration(spark, seed, budget, exclusive):
    names, capital, columns, weights = case(seed, 8, 25, 3)
    if seed == 1:
        columns.append((3, []))
    price = dict(capital)
    sets = [c for k in range(9) for c in combinations(names, k) if sum(price[p] for p in c) <= budget and all(len(set(c) & set(g)) <= 1 for g in exclusive or [])]
    want = min(((-value(c, columns, weights)[0], sum(price[p] for p in c), ",".join(c)) for c in sets))
    (got,) = bounded_investment(*frames(spark, columns, weights, capital), budget, exclusive, batch=8).collect()
    assert (-got.weight, got.cost, got.projects) == want and got.ods == value(got.projects.split(","), columns, weights)[1]


def test_sixty_projects(spark):
    """Two thirds of all capital may be spent: more than 2 ** 50 affordable sets. Held against greedy choices and exchanges of one or two projects."""
    rng = random.Random(7)
    names = [f"p{i:02d}" for i in range(60)]
    capital = [(p, float(rng.randint(1, 9))) for p in names]
    columns = [(o, rng.sample(names, rng.randint(1, 2))) for o in range(300) for _ in range(1 + (rng.random() < 0.15))]
    weights = [(o, float(rng.randint(1, 50))) for o in range(300)]
    price = dict(capital)
    budget = sum(price.values()) * 2 / 3
    (got,) = bounded_investment(*frames(spark, columns, weights, capital), budget).collect()
    chosen = set(got.projects.split(","))
    assert got.cost <= budget and got.weight == value(chosen, columns, weights)[0]
    for out in [(), *combinations(sorted(chosen), 1)]:
        for new in [(), *combinations([p for p in names if p not in chosen], 1)]:
            other = (chosen - set(out)) | set(new)
            if sum(price[p] for p in other) <= budget:
                assert value(other, columns, weights)[0] <= got.weight
