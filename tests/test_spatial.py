"""Lines, sites, running sums and audits against brute force."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from streetworth.functions import access as A
from streetworth.functions import tags as T
from streetworth.operators import audits as U
from streetworth.operators import context as K
from streetworth.operators import matching as L
from streetworth.operators import relational as R
from streetworth.operators import selection as S
from streetworth.operators import siting as P


def away(x, y, p, q, r, s):
    size = (r - p) ** 2 + (s - q) ** 2
    t = max(0.0, min(1.0, ((x - p) * (r - p) + (y - q) * (s - q)) / size)) if size else 0.0
    return math.hypot(x - p - t * (r - p), y - q - t * (s - q))


def test_near_share_is_what_sampling_gives(spark):
    r = random.Random(2)
    rows = [tuple(r.uniform(0, 120) for _ in range(8)) for _ in range(150)] + [(0.0, 0.0, 100.0, 0.0, 0.0, 10.0, 100.0, 10.0), (0.0, 0.0, 100.0, 0.0, 0.0, 30.0, 100.0, 30.0), (0.0, 0.0, 50.0, 0.0, 20.0, 5.0, 20.0, 5.0)]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, x1 double, y1 double, x2 double, y2 double, p1 double, q1 double, p2 double, q2 double")
    got = {r["id"]: r["share"] for r in L.with_near_share(frame, 20.0).collect()}
    for i, (x1, y1, x2, y2, *line) in enumerate(rows):
        n = 2000
        want = sum(away(x1 + (x2 - x1) * (j + 0.5) / n, y1 + (y2 - y1) * (j + 0.5) / n, *line) <= 20 for j in range(n)) / n
        assert got[i] == pytest.approx(want, abs=2e-3)


def test_facilities_need_layer_and_structure(spark):
    edges = [(1, 0.0, 0.0, 100.0, 0.0, 0, False, False), (2, 0.0, 200.0, 100.0, 200.0, 0, True, False), (3, 0.0, 400.0, 100.0, 400.0, 0, False, False), (4, 0.0, 600.0, 100.0, 600.0, 0, False, False)]
    features = [(10, 0.0, 5.0, 100.0, 5.0, "protected", 0, ""), (11, 0.0, 3.0, 100.0, 3.0, "mixed_traffic", 0, ""), (12, 100.0, 2.0, 0.0, 2.0, "painted", 0, ""), (20, 0.0, 201.0, 100.0, 201.0, "painted", 0, ""), (21, 0.0, 210.0, 90.0, 210.0, "shared", 0, "a bridge"), (30, 0.0, 400.0, 0.0, 500.0, "painted", 0, ""), (40, 0.0, 610.0, 55.0, 610.0, "painted", 1, "")]
    found = L.match_facilities(spark.createDataFrame(edges, "edge int, x1 double, y1 double, x2 double, y2 double, layer int, bridge boolean, tunnel boolean"), spark.createDataFrame(features, "feature int, p1 double, q1 double, p2 double, q2 double, facility string, layer_ int, structure string"), cell=70.0)
    got = {r["edge"]: (r["feature"], r["facility"], round(r["share"], 4)) for r in found.collect()}
    assert got == {1: (10, "protected", 1.0), 2: (21, "shared", 1.0)}


def test_exact_cover(spark):
    r = random.Random(4)
    for seed, k in ((1, 2), (2, 3)):
        r = random.Random(seed)
        sites = [(i, r.uniform(0, 100), r.uniform(0, 100), r.choice([0.0, 0.5, 1.0])) for i in range(12)]
        pairs = {(i, j): float(r.randint(1, 9)) for i in range(12) for j in range(20) if r.random() < 0.3}

        def value(s):
            return sum(max((pairs.get((i, j), 0.0) for i in s), default=0.0) for j in range(20)) + sum(sites[i][3] for i in s) * 0.3 / k  # noqa: B023

        apart = lambda s: all(math.hypot(sites[a][1] - sites[b][1], sites[a][2] - sites[b][2]) >= 25 for a, b in itertools.combinations(s, 2))  # noqa: B023, E731
        best = min((s for s in itertools.combinations(range(12), k) if apart(s)), key=lambda s: (-round(value(s), 9), s))
        got = P.exact_cover(spark.createDataFrame(sites, "site long, x double, y double, suitability double"), spark.createDataFrame([(i, j, g) for (i, j), g in pairs.items()], "site long, demand long, gain double"), k, 25.0).first()
        assert tuple(got.sites) == best and got.value == pytest.approx(value(best))


def test_running_sums_carry_over_partitions(spark):
    r = random.Random(9)
    rows = [(i, "hot" if i % 3 else f"g{i % 9}", r.randint(0, 9), float(r.randint(-3, 9))) for i in range(600)] + [(600, None, 1, 2.0), (601, None, 0, 3.0)]
    frame = spark.createDataFrame(rows, "id long, g string, o int, v double").repartition(7)
    got = {x["id"]: x["run"] for x in R.carried(frame, [F.col("o"), F.col("id")], F.col("v"), "run").collect()}
    total = 0.0
    for i, _, _, v in sorted(rows, key=lambda x: (x[2], x[0])):
        total += v
        assert got[i] == pytest.approx(total)
    got = {x["id"]: x["run"] for x in R.carried(frame, [F.col("o"), F.col("id")], F.col("v"), "run", F.max, before=True, by=["g"]).collect()}
    for g in {x[1] for x in rows}:
        top = None
        for i, _, _, v in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0])):
            assert got[i] == top
            top = v if top is None else max(top, v)
    assert R.carried(frame.where("false"), [F.col("id")], F.col("v"), "run").count() == 0


def test_water_fill_over_all_and_by_group(spark):
    r = random.Random(3)
    rows = [(i, f"z{i % 4}", float(r.randint(0, 5)) if i % 4 else 0.0, float(r.randint(0, 9))) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, z string, w double, cap double")
    for by, key in ((["z"], lambda x: x[1]), ([], lambda x: "")):
        got = {x["id"]: x["given"] for x in R.water_fill(frame, by, "w", "cap", F.sum("cap") * 0.4).collect()}
        groups = defaultdict(list)
        for x in rows:
            groups[key(x)].append(x)
        for own in groups.values():
            weights = {x[0]: x[2] if any(y[2] for y in own) else 1.0 for x in own}
            left, given, open_ = 0.4 * sum(x[3] for x in own), dict.fromkeys(weights, 0.0), {x[0]: x[3] for x in own if weights[x[0]]}
            while open_ and left > 1e-9:
                unit = left / sum(weights[i] for i in open_)
                full = [i for i, cap in open_.items() if cap - given[i] <= unit * weights[i] + 1e-12] or list(open_)
                for i in full:
                    add = min(open_[i] - given[i], unit * weights[i])
                    given[i], left = given[i] + add, left - add
                for i in full:
                    del open_[i]
            assert {i: round(v, 6) for i, v in given.items()} == {i: round(got[i], 6) + 0.0 for i in given}


def test_inversions_and_skylines(spark):
    r = random.Random(8)
    x = [r.randint(0, 50) for _ in range(200)]
    assert S.inversions(x) == sum(a > b for a, b in itertools.combinations(x, 2))
    rows = [(i, float(r.randint(0, 6)), float(r.randint(0, 6)), float(r.randint(0, 6))) for i in range(150)]
    got = {y["id"] for y in S.pareto_many(spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5), "id", ["a", "b"], ["c"]).where("efficient").collect()}
    assert got == {i for i, a, b, c in rows if not any(p >= a and q >= b and s <= c and (p > a or q > b or s < c) for _, p, q, s in rows)}


def test_access_rules(spark):
    rule = lambda kind, heading=None, modes=(), users=(), during=None, vehicle=False, part=(None, None): (kind, heading, list(modes), list(users), None, during, vehicle, *part)
    cases = [
        ([], True, (True, True, True)), ([], False, (False, False, False)),
        ([rule("denied", "backward")], True, (True, True, False)),  # one way, not for walkers
        ([rule("denied", "backward"), rule("allowed", None, ["bicycle"])], True, (True, True, False)),  # a word for bicycles does not lift a one-way
        ([rule("denied", "backward"), rule("allowed", "backward", ["bicycle"])], True, (True, True, True)),
        ([rule("denied", None, ["motor_vehicle"])], True, (True, True, True)), ([rule("denied", None, ["vehicle"])], True, (True, False, False)),
        ([rule("denied", None, users=["as_customer"])], True, (True, True, True)), ([rule("denied", during="Mo")], True, (True, True, True)), ([rule("denied", vehicle=True)], True, (True, True, True)),
        ([rule("denied"), rule("designated")], False, (True, True, True)), ([rule("allowed"), rule("denied")], True, (False, False, False)),
    ]
    frame = spark.createDataFrame([(i, r, d) for i, (r, d, _) in enumerate(cases)], f"id int, rules {A.RULES}, usual boolean")
    usual = F.col("usual")
    got = frame.select("id", A.open_to(F.col("rules"), "foot", None, usual).alias("w"), *(A.open_to(F.col("rules"), "bicycle", F.lit(h), usual).alias(h) for h in ("forward", "backward"))).collect()
    for r in got:
        assert tuple(r)[1:] == cases[r.id][2], cases[r.id]
    parts = spark.createDataFrame([([rule("denied", part=(0.2, 0.5)), rule("allowed")],)], f"rules {A.RULES}")
    sizes = parts.select(*(F.size(A.rules_between(F.col("rules"), F.lit(a), F.lit(b))) for a, b in ((0.0, 0.2), (0.1, 0.3), (0.5, 1.0)))).first()
    assert tuple(sizes) == (1, 2, 1)


def test_tags(spark):
    ways = [({"highway": "footway"}, False, "both"), ({"highway": "footway", "bicycle": "yes"}, True, "both"), ({"highway": "primary", "access": "private"}, False, "both"), ({"highway": "primary", "bicycle": "no"}, False, "both"), ({"highway": "motorway"}, False, "both"), ({}, False, "both"),
            ({"highway": "residential", "oneway": "yes"}, True, "forward"), ({"highway": "residential", "oneway": "yes", "oneway:bicycle": "no"}, True, "both"), ({"highway": "residential", "oneway": "yes", "cycleway:left": "opposite_lane"}, True, "both"), ({"highway": "residential", "oneway": "-1"}, True, "reverse"), ({"highway": "residential", "junction": "roundabout"}, True, "forward")]
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(ways)], "id int, tags map<string,string>")
    for r in frame.select("id", T.cycle_access(F.col("tags")).alias("a"), T.cycle_direction(F.col("tags")).alias("d")).collect():
        assert (r.a, r.d) == ways[r.id][1:], ways[r.id]
    names = spark.createDataFrame([("Library ( service lane - 26 Princes Street )",), ("Path (campus path)",), (None,), ("Hall (walk – Symonds Street) north",)], "n string")
    assert [r[0] for r in names.select(T.street_name(F.col("n"))).collect()] == ["Princes Street service lane", "Path (campus path)", None, "Symonds Street walk north"]
    speeds = spark.createDataFrame([("50",), ("30 mph",), ("60;80",), ("walk",), (None,)], "s string").select(T.number(F.col("s"))).collect()
    assert [r[0] if r[0] is None else round(r[0], 3) for r in speeds] == [50.0, 48.28, 60.0, None, None]


def test_tree_flows_and_contexts(spark):
    arcs = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 1, 1.0), (2, 4, 1.0), (1, 4, 9.0)]
    flows = K.tree_flows(spark.createDataFrame(arcs, "u long, v long, cost double"), spark.createDataFrame([(0, 4, 2.0), (3, 4, 3.0), (0, 2, 1.0), (4, 0, 7.0), (2, 2, 9.0)], "origin long, destination long, amount double"))
    assert {(r.u, r.v): r.flow for r in flows.collect()} == {(0, 1): 3.0, (3, 1): 3.0, (1, 2): 6.0, (2, 4): 5.0}
    edges = spark.createDataFrame([(1, 0, 1, 1, 10.0), (2, 2, 3, 2, 20.0), (3, 1, 2, 4, 5.0), (4, 8, 9, 4, 5.0), (5, 7, 7, 1, 1.0), (6, 3, 8, 4, 2.0)], "edge long, u long, v long, lts int, length double")
    nodes, sizes = K.low_stress_areas(edges)
    assert {(r.node, r.area) for r in nodes.collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (7, 7)}
    members = spark.createDataFrame([("join", 1, 1, 2, 5.0, "both"), ("out", 1, 3, 8, 2.0, "forward"), ("none", 1, 8, 9, 5.0, "reverse"), ("in", 1, 0, 1, 1.0, "both"), ("mix", 1, 0, 1, 1.0, "forward"), ("mix", 2, 1, 0, 1.0, "reverse")], "candidate string, place int, u long, v long, length double, direction string")
    got = {r.candidate: (r.role, r.direction, r.areas, r.area_length) for r in K.candidate_contexts(members, nodes, sizes).collect()}
    assert got == {"join": ("joins_areas", "both", 2, 30.0), "out": ("extends_area", "forward", 1, 20.0), "none": ("separate", "reverse", 0, 0.0), "in": ("within_area", "both", 1, 10.0), "mix": ("within_area", "mixed", 1, 10.0)}


def test_audits_find_what_is_planted(spark):
    ledger = [(1, "a", 2, True, 1.5, "assigned", None, [1, 2], [0.5, 0.5]), (2, "a", 2, True, 1.5, "assigned", None, [1], [0.9]), (3, "a", 2, False, 0.0, "not_selected", None, [], []), (3, "b", 1, True, 1.0, "unassigned", None, None, None), (4, "b", 1, False, 2.0, "assigned", "x", None, None)]
    rules = {r["rule"]: r["count"] for r in U.od_ledger(spark.createDataFrame(ledger, "od long, stratum string, stratum_sample int, selected boolean, weight double, status string, reason string, paths array<int>, probabilities array<double>")).collect()}
    assert rules == {"rows": 5, "list_lengths_differ": 0, "selected_without_weight": 0, "selected_with_unknown_status": 0, "unselected_with_other_status": 1, "unselected_with_paths_or_weight": 1, "assigned_without_paths": 1, "assigned_with_reason": 1, "probabilities_not_one": 1, "failed_without_reason": 1, "failed_with_paths": 0, "repeated_od": 1, "stratum_sample_differs": 0}
    units = spark.createDataFrame([(1, 5.0, 1.0, "assigned"), (2, 5.0, 1.0, "failed"), (3, 5.0, 2.0, "assigned")], "od long, eligible double, observed double, status string")
    rows = [(s, 1, 3.0) for s in range(5)] + [(s, 2, None) for s in range(4)] + [(0, 3, 1.0), (0, 3, 9.0), (1, 3, None), (2, 3, 2.0), (3, 3, 2.0), (4, 3, 2.0), (0, 9, 1.0)]
    rules = {r["rule"]: r["count"] for r in U.scenario_ledger(spark.createDataFrame(rows, "scenario int, od long, users double"), units).collect()}
    assert rules == {"rows": 15, "below_observed": 1, "above_eligible": 1, "assigned_without_users": 1, "users_without_route": 0, "unit_lacks_scenarios": 1, "repeated_rows": 1, "unknown_units": 1}
    found = U.rights(spark.createDataFrame([("a", "permitted", "include"), ("b", "restricted", "include"), ("c", "permitted", "exclude"), ("d", "permitted", "include")], "source string, redistribution string, decision string"), spark.createDataFrame([("l", "a"), ("l", "c"), ("m", "e"), ("m", "b")], "layer string, source string"), spark.createDataFrame([("a", "permitted"), ("b", "restricted"), ("c", "permitted"), ("d", "unknown"), ("f", "permitted")], "source string, redistribution string"))
    assert {(r.source, r.issue) for r in found.collect()} == {("b", "must_be_excluded"), ("c", "excluded_but_used"), ("d", "redistribution_differs"), ("d", "included_but_not_used"), ("e", "used_without_decision"), ("f", "no_decision")}
