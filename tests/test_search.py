"""Searches of ways over projects against brute force on small networks."""

import itertools
import random

import pytest

from streetworth.operators import search as S

ARC = "arc string, u long, v long, length double, time double, cost double, stress int, treated int, project string"
TURN = "arc string, next string, delay double, stress int, treated int, project string, banned boolean"


def network(seed, nodes=6, n=14):
    r = random.Random(seed)
    rows = []
    while len(rows) < n:
        u, v = r.sample(range(nodes), 2)
        stress = r.choice([1, 2, 3, 4])
        rows.append((f"a{len(rows):02}", u, v, float(r.randint(1, 9)), float(r.randint(1, 9)), float(r.randint(1, 9)), stress, min(stress, r.choice([1, 2, 3])), r.choice([None, "p", "q", "r"])))
    turns = []
    for x, y in itertools.product(rows, rows):
        if x[2] == y[1] and r.random() < 0.4:
            stress = r.choice([1, 1, 3])
            turns.append((x[0], y[0], float(r.randint(0, 3)), stress, 1, r.choice([None, "p", "s"]), r.random() < 0.2))
    return rows, turns


def walks(rows, turns, a, z, longest, slowest):
    """All ways within the limits, repeated nodes included: label by label, without any dominance."""
    by = {(t[0], t[1]): t for t in turns}
    out, todo = [], [(a, None, frozenset(), 0.0, 0.0, 0.0, ())]
    while todo:
        node, last, need, length, time, cost, route = todo.pop()
        if node == z and route:
            out.append((need, length, time, cost, route))
            continue
        for x in rows:
            if x[1] != node:
                continue
            more = set(need)
            if x[6] > 2:
                if not x[8] or x[7] > 2:
                    continue
                more.add(x[8])
            t = by.get((last, x[0]))
            delay = 0.0
            if t:
                if t[6] or (t[3] > 2 and not t[5]):
                    continue
                if t[3] > 2:
                    more.add(t[5])
                delay = t[2]
            now = (x[2], x[0], frozenset(more), length + x[3], time + x[4] + delay, cost + x[5] + delay, (*route, x[0]))
            if now[3] <= longest + 1e-9 and now[4] <= slowest + 1e-9:
                todo.append(now)
    return out


def shortest(rows, turns, a, z):
    banned = {(t[0], t[1]) for t in turns if t[6]}
    best, todo = None, [(a, None, 0.0)]
    seen = {}
    while todo:
        node, last, length = todo.pop()
        if node == z and last is not None:
            best = length if best is None else min(best, length)
            continue
        for x in rows:
            if x[1] == node and (last, x[0]) not in banned and length + x[3] < seen.get(x[0], 1e9):
                seen[x[0]] = length + x[3]
                todo.append((x[2], x[0], length + x[3]))
    return best


@pytest.mark.parametrize("seed", [1, 5])
def test_label_search(spark, seed):
    rows, turns = network(seed)
    capital = {"p": 3.0, "q": 2.0, "r": 4.0, "s": 1.0}
    ods = [(1, 0, 3), (2, 4, 1), (3, 2, 5), (4, 1, 77)]
    frames = spark.createDataFrame(rows, ARC), spark.createDataFrame(ods, "od long, origin long, destination long"), spark.createDataFrame(list(capital.items()), "project string, capital double")
    found, status = S.label_search(*frames, 6.0, stress=2, detour=1.6, most_time=18.0, turns=spark.createDataFrame(turns, TURN))
    found, stops = found.collect(), {r.od: r for r in status.collect()}
    assert stops[4].stop == "disconnected" and set(stops) == {1, 2, 3, 4}
    prices = [("low", 0.0, 0.0), ("high", 0.5, 5.0)]
    priced = {(r.price, r.od): r for r in S.priced_routes(*frames, 6.0, prices, funded=["q"], stress=2, detour=1.6, most_time=18.0, turns=spark.createDataFrame(turns, TURN)).collect()}
    exactly = {(r.price, r.od): r for r in S.priced_exactly(spark.createDataFrame(found), frames[2], prices, funded=["q"]).collect()}
    assert all(r.stop == "exhausted" for r in found) and priced["low", 4].stop == "disconnected"
    for od, a, z in ods[:3]:
        short = shortest(rows, turns, a, z)
        own = [r for r in found if r.od == od]
        if short is None:
            assert stops[od].stop == "disconnected" and not own
            continue
        assert stops[od].stop == "exhausted" and stops[od].shortest == short
        ways = [w for w in walks(rows, turns, a, z, short * 1.6, 18.0) if sum(capital[p] for p in w[0]) <= 6]
        keys = {w[:4] for w in ways}
        best = {w for w in keys if not any(o != w and o[0] <= w[0] and all(o[i] <= w[i] for i in (1, 2, 3)) for o in keys)}
        assert {(frozenset(r.projects), r.length, r.time, r.cost) for r in own} == best
        for r in own:
            assert (frozenset(r.projects), r.length, r.time, r.cost, tuple(r.route)) in ways and r.capital == sum(capital[p] for p in r.projects)
        for name, p, q in prices:
            got = priced.get((name, od))
            assert (got.score is None) == (not ways) and got.stop == ("heuristic" if ways else "no_way")
            exact = exactly.get((name, od))
            assert (exact is None) == (not ways)
            if ways:
                score = lambda w, p=p, q=q: w[3] + p * w[1] + q * sum(capital[x] for x in w[0] if x != "q")
                assert (frozenset(got.projects), got.length, got.time, got.cost, tuple(got.route)) in ways and got.score == pytest.approx(score((frozenset(got.projects), got.length, got.time, got.cost)))
                assert exact.score == pytest.approx(min(map(score, ways)))
                assert got.score >= min(map(score, ways)) - 1e-9 and (q or got.score == pytest.approx(min(map(score, ways))))


def test_label_limit_and_no_turns(spark):
    rows, _ = network(3, 7, 20)
    ods = spark.createDataFrame([(1, 0, 3), (2, 5, 1)], "od long, origin long, destination long")
    capital = spark.createDataFrame([(p, 1.0) for p in "pqr"], "project string, capital double")
    arcs = spark.createDataFrame(rows, ARC)
    _, status = S.label_search(arcs, ods, capital, 9.0, detour=3.0, most_labels=1)
    assert {r.stop for r in status.collect()} <= {"label_limit", "disconnected", "exhausted"}
    found, _ = S.label_search(arcs, ods, capital, 9.0, detour=2.0)
    for od, a, z in ((1, 0, 3), (2, 5, 1)):
        short = shortest(rows, [], a, z)
        keys = {w[:4] for w in walks(rows, [], a, z, short * 2, 1800.0)} if short else set()
        best = {w for w in keys if not any(o != w and o[0] <= w[0] and all(o[i] <= w[i] for i in (1, 2, 3)) for o in keys)}
        assert {(frozenset(r.projects), r.length, r.time, r.cost) for r in found.collect() if r.od == od} == best
