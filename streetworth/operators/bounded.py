"""The best affordable set of projects by branch and bound, for lists of projects whose sets can't be enumerated.

A node of the search is a set of projects to build and one not to build. Spark values a batch of nodes in one pass over the journeys' signatures; the driver keeps the open nodes, which are sets of
projects, and takes those of the highest bounds first.

The bound is additive. A signature that is not served yet gives each missing project of a need a share of the weight, in proportion to the projects' charges; of several needs the largest
share counts. Whatever set serves the signature holds all of one need, so its projects' shares add up to the weight at least. So the served weight, and the best fractional
choice of shares within the rest of the budget, bound what any set below the node can serve. Where a signature's shares add up to far more than its weight, the weight itself counts instead. Any charges give
a bound; they begin as costs and are moved, node by node, from projects that are chosen anyway to those that are not worth their cost, which tightens it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetworth.operators.graph import _save
from streetworth.operators.investment import signatures

_EPS = 1e-8


def _matrix(needs: list[list[list[int]]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 for each need, and where each signature's needs start."""
    starts = np.cumsum([0] + [len(s) for s in needs[:-1]])
    rows = np.zeros((sum(map(len, needs)), n), bool)
    for i, need in enumerate(x for s in needs for x in s):
        rows[i, need] = True
    return rows, starts


#: Where shares add up to more than this many times the weight, the weight counts instead.
_SPREAD = 1.35


def _valued(nodes: list[tuple[int, list[int], list[int], float, np.ndarray]], cost: np.ndarray):
    """For each node (id, built, barred, left, charges): the shares of each project in the partition's signatures, the weight and ods served, the weight that counts whole, and that which can still be served."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cost)
        totals = np.zeros((len(nodes), n + 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            weight, ods = batch.column("weight").to_numpy(zero_copy_only=False), batch.column("ods").to_numpy(zero_copy_only=False)
            rows, starts = _matrix(batch.column("needs").to_pylist(), n)
            of = np.repeat(np.arange(len(weight)), np.diff(np.append(starts, len(rows))))
            for k, (_, built, barred, left, charge) in enumerate(nodes):
                missing = rows.copy()
                missing[:, built] = False
                lack = missing @ cost
                open_ = ~missing.any(1)
                served = np.logical_or.reduceat(open_, starts)
                can = ~(missing[:, barred].any(1)) & ~served[of] & (lack <= left + _EPS)
                paid = missing * charge
                share = np.where(can[:, None], paid * (weight[of] / np.maximum(paid.sum(1), 1e-300))[:, None], 0.0)
                share = np.maximum.reduceat(share, starts, axis=0)
                whole = share.sum(1) > _SPREAD * weight
                totals[k, :n] += share[~whole].sum(0)
                totals[k, n:] += weight[served].sum(), ods[served].sum(), weight[whole].sum(), weight[np.logical_or.reduceat(can, starts)].sum()
        yield pa.record_batch({"node": pa.array([x[0] for x in nodes], pa.int64()), "sums": pa.array(totals.tolist(), pa.list_(pa.float64()))})

    return run


def _fill(shares: np.ndarray, cost: np.ndarray, left: float) -> tuple[float, list[int]]:
    """The most that shares of projects give within `left`, the last one in part, and the projects that fit whole in that order."""
    some = np.flatnonzero((shares > 0) & (cost <= left + _EPS))
    order = some[np.argsort(-shares[some] / np.maximum(cost[some], 1e-12), kind="stable")]
    value, whole, rest, full = 0.0, [], left, False
    for p in order.tolist():
        if not full and cost[p] > rest + _EPS:
            value, full = value + shares[p] * rest / cost[p], True
        elif not full:
            value, rest = value + shares[p], rest - cost[p]
            whole.append(p)
            continue
        if cost[p] <= rest + _EPS:
            rest -= cost[p]
            whole.append(p)
    return value, whole


def _charged(charge: np.ndarray, shares: np.ndarray, cost: np.ndarray, left: float, step: float) -> np.ndarray:
    """Charges moved towards where every project's shares are worth its cost at the rate of the last project that the budget takes."""
    worth = shares / np.maximum(cost, 1e-12)
    order = np.argsort(-worth)
    rate = worth[order[min(int(np.searchsorted(np.cumsum(cost[order]), left)), len(order) - 1)]]
    ratio = np.where(shares > 1e-12, rate * cost / np.maximum(shares, 1e-12), 1.0)
    return np.maximum(charge * np.clip(ratio, 0.2, 5.0) ** step, 1e-9)


def bounded_investment(columns: DataFrame, weights: DataFrame, capital: DataFrame, budget: float, exclusive: list[list[str]] | None = None, batch: int = 512) -> DataFrame:
    """One row (projects, cost, weight, ods): the affordable set of projects that serves most weight of weights(od, weight), then of least cost, then of the smallest names.

    columns(od, projects) says which projects each route needs, capital(project, capital) what they cost (not below 0); projects without a cost can't be built, and at most one of an
    exclusive group is. Costs of 0 are built first of all. Exact: a node goes only if its bound is below the best weight found, or equals it and the node costs more already.
    """
    spark = columns.sparkSession
    prices = {r.project: float(r.capital) for r in capital.where("project is not null and capital is not null").collect()}  # the list of projects
    names = sorted(prices)
    at = F.create_map(*[F.lit(x) for i, p in enumerate(names) for x in (p, i)]) if names else F.expr("cast(map() as map<string,int>)")
    needs = F.filter(F.transform("needs", lambda s: F.transform(s, lambda p: F.coalesce(F.try_element_at(at, p), F.lit(-1)))), lambda s: ~F.array_contains(s, F.lit(-1)))
    own = _save(signatures(columns, weights).select(needs.alias("needs"), "weight", F.col("ods").cast("double").alias("ods")).where(F.size("needs") > 0))
    cost, n = np.array([prices[p] for p in names]), len(names)
    rivals = [{names.index(p) for p in g if p in prices} for g in exclusive or []]

    def barred(built: frozenset[int]) -> frozenset[int]:
        return frozenset(q for g in rivals for p in built & g for q in g - {p})

    def key(built: frozenset[int]) -> tuple[float, str]:
        return round(float(cost[sorted(built)].sum()), 9), ",".join(names[i] for i in sorted(built))

    free = frozenset(i for i in range(n) if cost[i] <= 0 and not any(i in g for g in rivals))
    best: tuple | None = None


    def valued(nodes: list[tuple]) -> np.ndarray:
        """_valued() of all signatures; as many numbers as nodes and projects come to the driver."""
        sums = own.mapInArrow(_valued(nodes, cost), "node long, sums array<double>").select("node", F.posexplode("sums").alias("i", "v")).groupBy("node", "i").agg(F.sum("v").alias("v")).collect()
        value = np.zeros((len(nodes), n + 4))
        for r in sums:
            value[r["node"], r["i"]] = r["v"]
        return value

    def room(built: frozenset[int]) -> float:
        return budget - float(cost[sorted(built)].sum())

    charge, tightest = np.maximum(cost, 1e-9), (np.inf, np.maximum(cost, 1e-9))
    for _ in range(12 if n else 0):
        (v,) = valued([(0, sorted(free), [], room(free), charge)])
        bound = v[n] + v[n + 2] + _fill(v[:n], cost, room(free))[0]
        tightest = min(tightest, (bound, charge), key=lambda t: t[0])
        charge = _charged(charge, v[:n], cost, room(free), 0.3)
    heap, order, seen = [(-np.inf, 0, free, frozenset(), tightest[1])], count(1), set()
    while heap:
        taken = []
        while heap and len(taken) < batch:
            bound, _, built, shut, charge = heapq.heappop(heap)
            if best is None or -bound > best[0] + _EPS or (-bound >= best[0] - _EPS and key(built) <= best[1]):
                taken.append((built, shut, charge, True))
        probes: list[frozenset[int]] = []
        for _ in range(2):
            # First the nodes, then the sets that their bounds propose, as something to beat.
            work = taken or [(p, frozenset(), tightest[1], False) for p in probes]
            if not work:
                break
            value = valued([(k, sorted(b), sorted(s), room(b), c) for k, (b, s, c, _) in enumerate(work)])
            for (built, shut, charge, grows), v in zip(work, value, strict=True):
                here = (v[n], key(built), built, int(v[n + 1]))
                if best is None or here[0] > best[0] + _EPS or (here[0] >= best[0] - _EPS and here[1] < best[1]):
                    best = here
                if not grows:
                    continue
                left = room(built)
                shares = v[:n].copy()
                shares[sorted(built | shut)] = 0
                more, whole = _fill(shares, cost, left)
                picked = set(built)
                for p in whole:
                    if not barred(frozenset(picked)) & {p}:
                        picked.add(p)
                if picked != built and frozenset(picked) not in seen:
                    seen.add(frozenset(picked))
                    probes.append(frozenset(picked))
                open_ = [p for p in np.argsort(-shares, kind="stable").tolist() if shares[p] > 0 and cost[p] <= left + _EPS]
                if not open_ and v[n + 2] > 0:
                    # What is left counts whole: any project of it may be next.
                    open_ = [p for p in range(n) if p not in built | shut and cost[p] <= left + _EPS]
                if open_:
                    p, bound = open_[0], -(v[n] + min(v[n + 2] + more, v[n + 3]))
                    with_p, charge = built | {p}, _charged(charge, shares, cost, left, 0.2)
                    heapq.heappush(heap, (bound, next(order), with_p, shut | barred(with_p), charge))
                    heapq.heappush(heap, (bound, next(order), built, shut | {p}, charge))
            taken = []
        heap = [h for h in heap if -h[0] > best[0] + _EPS or (-h[0] >= best[0] - _EPS and key(h[2]) <= best[1])]
        heapq.heapify(heap)
    built = best[2] if best else frozenset()
    needed = frozenset(built)
    row = (",".join(names[i] for i in sorted(needed)), float(cost[sorted(needed)].sum()), float(best[0]) if best else 0.0, best[3] if best else 0)
    return spark.createDataFrame([row], "projects string, cost double, weight double, ods long")
