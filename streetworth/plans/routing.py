"""Queries on routes, investments and facilities, over a ring of the nations with chords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.operators import graph as G
from streetworth.operators import investment as I
from streetworth.operators import routing as R
from streetworth.operators import search as W
from streetworth.operators.bounded import bounded_investment
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table
from streetworth.registry import SQL, query

#: Arcs from each nation to the next, the fifth and the seventh after it; some chords are closed until a project opens them.
_RING = """ring AS (SELECT n_nationkey * 3 + j AS arc, CAST(n_nationkey AS BIGINT) AS u, CAST((n_nationkey + (CASE j WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 7 END)) % 25 AS BIGINT) AS v,
CAST((CASE j WHEN 0 THEN 10 WHEN 1 THEN 40 ELSE 60 END) + n_nationkey * 7 % 5 AS DOUBLE) AS length, CAST((CASE j WHEN 0 THEN 10 WHEN 1 THEN 40 ELSE 60 END) + n_nationkey * 7 % 5 AS DOUBLE) * (1 + (n_nationkey + j) % 4) AS cost,
CASE WHEN j > 0 AND n_nationkey % 2 = 0 THEN 'p' || (n_nationkey // 2 % 6) END AS project FROM nation, (VALUES (0), (1), (2)) t(j))"""
_TRIPS = """trips AS (SELECT CAST(c_nationkey AS BIGINT) * 25 + s_nationkey AS od, CAST(c_nationkey AS BIGINT) AS origin, CAST(s_nationkey AS BIGINT) AS destination, sum(l_quantity) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3)"""
BUDGET = 5.0


def ring(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    each = table(spark, d, "nation").select(n.alias("n"), F.posexplode(F.array(*map(F.lit, (1, 5, 7)))).alias("j", "hop"))
    length = (F.element_at(F.array(*map(F.lit, (10, 40, 60))), F.col("j") + 1) + F.col("n") * 7 % 5).cast("double")
    project = F.when((F.col("j") > 0) & (F.col("n") % 2 == 0), F.concat(F.lit("p"), (F.floor(F.col("n") / 2) % 6).cast("string")))
    rows = each.select((F.col("n") * 3 + F.col("j")).alias("arc"), F.col("n").alias("u"), ((F.col("n") + F.col("hop")) % 25).alias("v"), length.alias("length"), (1 + (F.col("n") + F.col("j")) % 4).alias("_m"), project.alias("project"))
    return rows.withColumn("cost", F.col("length") * F.col("_m")).drop("_m")


def trips(spark: SparkSession, d: str) -> DataFrame:
    """One journey for each pair of nations of a customer and a supplier, with the quantity ordered."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, z = F.col("c_nationkey").cast("long"), F.col("s_nationkey").cast("long")
    return rows.where("c_nationkey <> s_nationkey").groupBy((a * 25 + z).alias("od"), a.alias("origin"), z.alias("destination")).agg(F.sum("l_quantity").alias("amount"))


def capital(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"p{i}", 1.0 + i) for i in range(6)], "project string, capital double")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.array_join(c, ",") for c, t in rows.dtypes if t.startswith("array")})


_CYCLES = "links AS (SELECT p_partkey AS u, p_partkey % 97 * 3 + 1 AS v FROM part UNION SELECT p_partkey % 97 * 3 + 1, p_partkey FROM part WHERE p_size % 4 = 0), arcs AS (SELECT u, v FROM links WHERE u <> v)"


@query(f"WITH RECURSIVE {_CYCLES}, reach AS (SELECT u AS a, u AS b FROM arcs UNION SELECT v, v FROM arcs UNION SELECT a, v FROM reach JOIN arcs ON b = u) SELECT CAST(r.a AS BIGINT) AS id, CAST(min(r.b) AS BIGINT) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY 1")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    hub = p % 97 * 3 + 1
    part = table(spark, d, "part")
    return R.strong_components(part.select(p.alias("u"), hub.alias("v")).union(part.where("p_size % 4 = 0").select(hub, p)))


@query(f"""WITH {_RING} SELECT a.arc, b.arc AS next, a.v AS node FROM ring a JOIN ring b ON a.v = b.u AND a.u <> b.v AND a.arc <> b.arc""")
def turn_movements(spark: SparkSession, d: str) -> DataFrame:
    return R.movements(ring(spark, d))


_COSTS = "{0}(source, node, far, hops) AS (SELECT DISTINCT u, u, 0e0, 0 FROM ring UNION ALL SELECT source, node, min(far), hops FROM (SELECT source, g.v AS node, far + g.length AS far, hops + 1 AS hops FROM {0} JOIN ring g ON node = g.u WHERE hops < 25{1}) GROUP BY 1, 2, 4)"


@query(f"""WITH RECURSIVE {_RING}, {_TRIPS}, {_COSTS.format("plain", "")}, {_COSTS.format("calm", " AND (g.u + g.arc - g.u * 3) % 4 < 3")}, a AS (SELECT source, node, min(far) AS near FROM plain GROUP BY 1, 2), b AS (SELECT source, node, min(far) AS calm FROM calm GROUP BY 1, 2)
SELECT count(*) AS ods, round(sum(CASE WHEN calm <= 1.25e0 * near THEN amount ELSE 0e0 END) / sum(amount), 8) AS connected FROM trips JOIN a ON a.source = origin AND a.node = destination LEFT JOIN b ON b.source = origin AND b.node = destination""")
def low_stress_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Share of demand whose way on calm arcs is at most a quarter longer than its shortest."""
    arcs, ods = ring(spark, d), trips(spark, d)
    starts = ods.select(F.col("origin").alias("source")).distinct()
    costs = lambda t, n: G.shortest_costs(t.select("u", "v", F.col("length").alias("cost")), starts, float("inf")).select(F.col("source").alias("origin"), F.col("node").alias("destination"), F.col("cost").alias(n))
    both = ods.join(costs(arcs, "near"), ["origin", "destination"]).join(costs(arcs.where("(u + arc - u * 3) % 4 < 3"), "calm"), ["origin", "destination"], "left")
    return both.agg(F.count("*").alias("ods"), F.round(F.sum(F.when(F.col("calm") <= 1.25 * F.col("near"), F.col("amount")).otherwise(0.0)) / F.sum("amount"), 8).alias("connected"))


#: Ways of every journey under projects, turns and limits, label by label, none dropped but by the limits.
_WAYS = f"""{_RING}, {_TRIPS}, turns AS (SELECT a.arc, b.arc AS next, CASE WHEN a.arc % 3 = b.arc % 3 THEN 2e0 ELSE 0e0 END AS delay, a.arc % 7 = 3 AND b.arc % 5 = 1 AS banned FROM ring a JOIN ring b ON a.v = b.u),
line(source, arc, far, hops) AS (SELECT u, arc, length, 1 FROM ring UNION ALL SELECT source, arc, min(far), hops FROM (SELECT source, next AS arc, far + g.length AS far, hops + 1 AS hops FROM line l JOIN turns t ON t.arc = l.arc AND NOT banned JOIN ring g ON g.arc = next WHERE hops < 30) GROUP BY 1, 2, 4),
legal AS (SELECT source, v AS goal, min(far) AS short FROM line JOIN ring USING (arc) GROUP BY 1, 2), back(goal, node, far, hops) AS (SELECT DISTINCT v, v, 0e0, 0 FROM ring UNION ALL SELECT goal, node, min(far), hops FROM (SELECT goal, g.u AS node, far + g.length AS far, hops + 1 AS hops FROM back JOIN ring g ON node = g.v WHERE hops < 25) GROUP BY 1, 2, 4),
rest AS (SELECT goal, node, min(far) AS rest FROM back GROUP BY 1, 2), priced AS (SELECT arc, u, v, length, cost, CASE WHEN project IS NULL THEN 0 ELSE 1 << CAST(substr(project, 2) AS INTEGER) END AS bit FROM ring),
walk AS (SELECT od, destination AS goal, 1.25e0 * short + 1e-9 AS most, g.v AS node, g.arc, g.bit AS mask, g.length, g.length / 4e0 AS time, g.cost, lpad(CAST(g.arc AS VARCHAR), 3, '0') AS route FROM trips JOIN legal ON source = origin AND goal = destination JOIN priced g ON g.u = origin JOIN rest r ON r.goal = destination AND r.node = g.v WHERE g.length + rest <= 1.25e0 * short + 1e-9
  UNION ALL SELECT od, w.goal, most, g.v, g.arc, mask | g.bit, w.length + g.length, time + g.length / 4e0 + delay, w.cost + g.cost + delay, route || ',' || lpad(CAST(g.arc AS VARCHAR), 3, '0') FROM walk w JOIN turns t ON t.arc = w.arc AND NOT banned JOIN priced g ON g.arc = next JOIN rest r ON r.goal = w.goal AND r.node = g.v
  WHERE w.node <> w.goal AND w.length + g.length + rest <= most AND list_sum([CASE WHEN (mask | g.bit) & (1 << i) > 0 THEN 1 + i ELSE 0 END FOR i IN range(6)]) <= 5),
ways AS (SELECT od, mask, round(length, 6) AS length, round(time, 6) AS time, round(cost, 6) AS cost, min(route) AS route, list_sum([CASE WHEN mask & (1 << i) > 0 THEN 1 + i ELSE 0 END FOR i IN range(6)]) AS capital FROM walk WHERE node = goal AND list_sum([CASE WHEN mask & (1 << i) > 0 THEN 1 + i ELSE 0 END FOR i IN range(6)]) <= 5 GROUP BY 1, 2, 3, 4, 5)"""


def _search_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ring with times and stress (an arc that a project opens is calm once it is built), and turns of which some are banned and some slow."""
    own = F.col("project").isNotNull()
    arcs = ring(spark, d).withColumns({"time": F.col("length") / 4, "stress": F.when(own, 4).otherwise(1), "treated": F.lit(1)})
    a, b = F.col("arc"), F.col("next")
    met = arcs.select("arc", F.col("v").alias("at")).join(arcs.select(F.col("arc").alias("next"), F.col("u").alias("at")), "at")
    turns = met.select("arc", "next", F.when(a % 3 == b % 3, 2.0).otherwise(0.0).alias("delay"), F.lit(1).alias("stress"), F.lit(1).alias("treated"), F.lit(None).cast("string").alias("project"), ((a % 7 == 3) & (b % 5 == 1)).alias("banned"))
    return arcs, trips(spark, d).select("od", "origin", "destination"), turns


@query(f"""WITH RECURSIVE {_WAYS} SELECT od, coalesce(array_to_string([CASE WHEN mask & (1 << i) > 0 THEN 'p' || i END FOR i IN range(6)], ','), '') AS projects, length, time, cost, CAST(capital AS DOUBLE) AS capital, 'exhausted' AS stop FROM ways a
WHERE NOT EXISTS (SELECT 1 FROM ways b WHERE b.od = a.od AND b.mask & a.mask = b.mask AND b.length <= a.length AND b.time <= a.time AND b.cost <= a.cost AND (b.mask <> a.mask OR b.length < a.length OR b.time < a.time OR b.cost < a.cost))""")
def label_search(spark: SparkSession, d: str) -> DataFrame:
    """Efficient ways of every journey over projects, length, time and cost."""
    arcs, ods, turns = _search_inputs(spark, d)
    found, _ = W.label_search(arcs, ods, capital(spark), BUDGET, detour=1.25, turns=turns)
    return _named(found.select("od", "projects", *(F.round(c, 6).alias(c) for c in ("length", "time", "cost")), "capital", "stop"))


@query(f"""WITH RECURSIVE {_WAYS.replace("<= 5", "<= 100")}, p AS (SELECT price, od, cost + l * length AS score FROM ways CROSS JOIN (VALUES ('free', 0e0), ('short', 2e0)) v(price, l)) SELECT price, od, round(min(score), 6) AS score, 'exact' AS stop FROM p GROUP BY 1, 2""")
def priced_route(spark: SparkSession, d: str) -> DataFrame:
    """The least score of every journey at two prices of length. The budget binds nobody and capital is free, so that no label that goes could have won."""
    arcs, ods, turns = _search_inputs(spark, d)
    found = W.priced_routes(arcs, ods, capital(spark), 100.0, [("free", 0.0, 0.0), ("short", 2.0, 0.0)], detour=1.25, turns=turns)
    return found.select("price", "od", F.round("score", 6).alias("score"), "stop")


@query()
def priced_programme_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes at prices of length and capital, with one project already funded."""
    arcs, ods, turns = _search_inputs(spark, d)
    return _named(W.priced_routes(arcs, ods, capital(spark), BUDGET, [("thrifty", 0.0, 20.0), ("both", 2.0, 20.0)], funded=["p1"], detour=1.25, turns=turns))


@query(f"""WITH RECURSIVE {_WAYS}, p AS (SELECT price, od, cost + l * length + 20e0 * list_sum([CASE WHEN mask & (1 << i) > 0 AND i <> 1 THEN 1e0 + i ELSE 0e0 END FOR i IN range(6)]) AS score FROM ways CROSS JOIN (VALUES ('thrifty', 0e0), ('both', 2e0)) v(price, l)) SELECT price, od, round(min(score), 6) AS score FROM p GROUP BY 1, 2""")
def priced_programme_exact(spark: SparkSession, d: str) -> DataFrame:
    """The least score of every journey at prices of length and capital, with one project already funded, out of all efficient ways."""
    arcs, ods, turns = _search_inputs(spark, d)
    ways = G._save(W.label_search(arcs, ods, capital(spark), BUDGET, detour=1.25, turns=turns)[0])
    return W.priced_exactly(ways, capital(spark), [("thrifty", 0.0, 20.0), ("both", 2.0, 20.0)], funded=["p1"]).select("price", "od", F.round("score", 6).alias("score"))


@query()
def search_stops(spark: SparkSession, d: str) -> DataFrame:
    """Why each journey's search ended under a small limit of labels."""
    arcs, ods, turns = _search_inputs(spark, d)
    _, status = W.label_search(arcs, ods, capital(spark), BUDGET, detour=1.25, turns=turns, most_labels=40)
    return status.groupBy("stop").agg(F.count("*").alias("ods"), F.sum("labels").alias("labels"))


_BACK = "{0}(goal, node, far, hops) AS (SELECT DISTINCT v, v, 0e0, 0 FROM ring UNION ALL SELECT goal, node, min(far), hops FROM (SELECT goal, g.u AS node, far + g.{1} AS far, hops + 1 AS hops FROM {0} JOIN ring g ON node = g.v WHERE hops < 25) GROUP BY 1, 2, 4)"
#: All simple routes of every journey within a quarter of the cheapest and of the shortest.
_SIMPLE = f"""{_RING}, {_TRIPS}, {_BACK.format("by_cost", "cost")}, {_BACK.format("by_length", "length")}, left_ AS (SELECT goal, node, c, l FROM (SELECT goal, node, min(far) AS c FROM by_cost GROUP BY 1, 2) JOIN (SELECT goal, node, min(far) AS l FROM by_length GROUP BY 1, 2) USING (goal, node)),
lim AS (SELECT od, origin, destination AS goal, c * 1.25e0 + 1e-9 AS most_cost, l * 1.25e0 + 1e-9 AS most_length FROM trips JOIN left_ ON goal = destination AND node = origin),
walk AS (SELECT od, goal, most_cost, most_length, origin AS node, [origin] AS seen, CAST([] AS BIGINT[]) AS arcs, 0e0 AS length, 0e0 AS cost FROM lim UNION ALL SELECT od, w.goal, most_cost, most_length, g.v, list_append(seen, g.v), list_append(arcs, CAST(g.arc AS BIGINT)), w.length + g.length, w.cost + g.cost
  FROM walk w JOIN ring g ON g.u = w.node JOIN left_ r ON r.goal = w.goal AND r.node = g.v WHERE w.node <> w.goal AND NOT list_contains(seen, g.v) AND w.length + g.length + l <= most_length AND w.cost + g.cost + c <= most_cost),
inside AS (SELECT od, arcs, length, cost FROM walk WHERE node = goal), lone AS (SELECT od, goal, most_length / 1.25e0 AS short, origin AS node, CAST([] AS BIGINT[]) AS arcs, 0e0 AS length, 0e0 AS cost FROM lim WHERE od NOT IN (SELECT od FROM inside)
  UNION ALL SELECT od, w.goal, short, g.v, list_append(arcs, CAST(g.arc AS BIGINT)), w.length + g.length, w.cost + g.cost FROM lone w JOIN ring g ON g.u = w.node JOIN left_ r ON r.goal = w.goal AND r.node = g.v WHERE w.node <> w.goal AND w.length + g.length + l <= short + 1e-6),
alone AS (SELECT od, min_by({{'arcs': arcs, 'length': length, 'cost': cost}}, (length, arcs)) AS b FROM lone WHERE node = goal GROUP BY 1), routes AS (SELECT * FROM inside UNION ALL SELECT od, b.arcs, b.length, b.cost FROM alone), lengths AS (SELECT map_from_entries(list((CAST(arc AS BIGINT), length))) AS m FROM ring)"""
_FIRST = "SELECT r.od, min_by({{'arcs': r.arcs, 'length': r.length, 'cost': r.cost}}, (r.cost, r.arcs)) AS b FROM routes r {joins}, lengths WHERE {tests} GROUP BY 1"
_OTHER = "r.arcs <> {0}.b.arcs AND coalesce(list_sum(list_transform(list_intersect(r.arcs, {0}.b.arcs), lambda a: m[a])), 0e0) <= 0.95e0 * r.length + 1e-12"
_PLAUSIBLE = f"""{_SIMPLE}, one AS ({_FIRST.format(joins="", tests="true")}), two AS ({_FIRST.format(joins="JOIN one USING (od)", tests=_OTHER.format("one"))}), three AS ({_FIRST.format(joins="JOIN one USING (od) JOIN two USING (od)", tests=_OTHER.format("one") + " AND " + _OTHER.format("two"))}),
plausible AS (SELECT od, 1 AS option, b.arcs, b.length, b.cost FROM one UNION ALL SELECT od, 2, b.arcs, b.length, b.cost FROM two UNION ALL SELECT od, 3, b.arcs, b.length, b.cost FROM three)"""


@query(f"WITH RECURSIVE {_PLAUSIBLE} SELECT od, option, array_to_string(arcs, ',') AS route, length, cost FROM plausible")
def k_plausible_paths(spark: SparkSession, d: str) -> DataFrame:
    """Up to three ways of each journey, in order of cost."""
    return _named(R.plausible_paths(ring(spark, d), trips(spark, d), dearer=1.25, detour=1.25))


@query(f"""WITH RECURSIVE {_RING}, {_TRIPS}, {_BACK.format("by_length", "length")}, left_ AS (SELECT goal, node, min(far) AS l FROM by_length GROUP BY 1, 2), lone AS (SELECT od, destination AS goal, l AS short, origin AS node, CAST([] AS BIGINT[]) AS arcs, 0e0 AS length FROM trips JOIN left_ ON goal = destination AND node = origin
UNION ALL SELECT od, w.goal, short, g.v, list_append(arcs, CAST(g.arc AS BIGINT)), w.length + g.length FROM lone w JOIN ring g ON g.u = w.node JOIN left_ r ON r.goal = w.goal AND r.node = g.v WHERE w.node <> w.goal AND w.length + g.length + l <= short + 1e-6)
SELECT od, array_to_string(min_by(arcs, (round(length, 6), arcs)), ',') AS route, round(min(length), 6) AS length FROM lone WHERE node = goal GROUP BY 1""")
def corridors_between_terminals(spark: SparkSession, d: str) -> DataFrame:
    """The shortest physical way between two terminals, of equal ones the smallest, as a corridor of exact arcs."""
    found = R.least_routes(ring(spark, d), trips(spark, d).select("od", "origin", "destination"), "length")
    return found.select("od", F.array_join("route", ",").alias("route"), F.round("total", 6).alias("length"))


@query()
def penalty_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return _named(R.penalised_paths(ring(spark, d), trips(spark, d), repeats=3))


@query(f"""WITH RECURSIVE {_PLAUSIBLE}, e AS (SELECT od, option, p.cost, unnest(arcs) AS arc FROM plausible p), n AS (SELECT e.*, g.length, count(*) OVER (PARTITION BY od, e.arc) AS n FROM e JOIN ring g USING (arc)), s AS (SELECT od, option, any_value(cost) AS cost, greatest(1e-12, least(1e0, sum(length / n) / sum(length))) AS size FROM n GROUP BY 1, 2),
u AS (SELECT *, -0.002e0 * cost + ln(size) AS u FROM s), w AS (SELECT *, exp(u - max(u) OVER (PARTITION BY od)) AS w FROM u), p AS (SELECT *, w / sum(w) OVER (PARTITION BY od) AS p FROM w) SELECT arc, round(sum(amount * p), 6) AS flow FROM p JOIN e USING (od, option) JOIN trips USING (od) GROUP BY 1""")
def assign_demand_edge_flow(spark: SparkSession, d: str) -> DataFrame:
    arcs, ods = ring(spark, d), trips(spark, d)
    paths = G._save(R.plausible_paths(arcs, ods, dearer=1.25, detour=1.25))
    return R.assign_flows(paths, arcs, ods)[0].select("arc", F.round("flow", 6).alias("flow"))


_BEST = "{0}(candidate, source, node, far, hops) AS (SELECT DISTINCT candidate, u, u, 0e0, 0 FROM {1} UNION ALL SELECT candidate, source, node, min(far), hops FROM (SELECT c.candidate, source, g.v AS node, far + g.cost AS far, hops + 1 AS hops FROM {0} c JOIN {1} g ON node = g.u AND c.candidate = g.candidate WHERE hops < 25) GROUP BY 1, 2, 3, 5)"


@query(f"""WITH RECURSIVE {_RING}, {_TRIPS}, names AS (SELECT DISTINCT project AS candidate FROM ring WHERE project IS NOT NULL), kept AS (SELECT candidate, u, v, CASE WHEN project = candidate THEN cost * 0.5e0 ELSE cost END AS cost FROM ring, names UNION ALL SELECT '', u, v, cost FROM ring),
{_BEST.format("walk", "kept")}, best AS (SELECT candidate, source, node, min(far) AS cost FROM walk GROUP BY 1, 2, 3)
SELECT a.candidate, od, b.cost AS before, a.cost AS after, 'evaluated' AS status FROM trips JOIN best a ON a.source = origin AND a.node = destination AND a.candidate <> '' JOIN best b ON b.source = origin AND b.node = destination AND b.candidate = ''""")
def candidate_reroute_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Least costs of every journey before and after each project halves its arcs' costs."""
    arcs = ring(spark, d)
    return R.rerouted(arcs, arcs.where("project is not null").select(F.col("project").alias("candidate"), "arc", F.lit(0.5).alias("keep")), trips(spark, d))


#: Columns: each order needs the groups of brands of one of its lines' parts.
_COLUMNS = """cols AS (SELECT DISTINCT l_orderkey AS od, l_linenumber AS line, p_size % 9 AS bit FROM lineitem JOIN part ON l_partkey = p_partkey), needs AS (SELECT DISTINCT od, CAST(sum(1 << bit) AS BIGINT) AS need FROM cols GROUP BY od, line),
weights AS (SELECT o_orderkey AS od, CAST(1 + o_orderkey % 7 AS DOUBLE) AS weight FROM orders)"""


def _columns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    packs = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_set(F.concat(F.lit("p"), (F.col("p_size") % 9).cast("string")))).alias("projects"))
    weights = table(spark, d, "orders").select(F.col("o_orderkey").alias("od"), (1.0 + F.col("o_orderkey") % 7).alias("weight"))
    costs = spark.createDataFrame([(f"p{i}", 2.0 + i * 5 % 7) for i in range(9)], "project string, capital double")
    return packs.select(F.col("l_orderkey").alias("od"), "projects").distinct(), weights, costs


@query(f"""WITH {_COLUMNS}, sets AS (SELECT m AS mask, CAST(list_sum([CASE WHEN m & (1 << i) > 0 THEN 2e0 + i * 5 % 7 ELSE 0e0 END for i in range(9)]) AS DOUBLE) AS cost, array_to_string([CASE WHEN m & (1 << i) > 0 THEN 'p' || i END for i in range(9)], ',') AS projects FROM range(512) t(m)),
served AS (SELECT DISTINCT mask, od FROM sets JOIN needs ON mask & need = need WHERE cost <= 20), sums AS (SELECT mask, sum(weight) AS weight, count(*) AS ods FROM served JOIN weights USING (od) GROUP BY 1)
SELECT projects, cost, weight, ods FROM sets JOIN sums USING (mask) WHERE cost <= 20 ORDER BY weight DESC, cost, projects LIMIT 1""")
def investment_exact(spark: SparkSession, d: str) -> DataFrame:
    return I.exact_investment(*_columns(spark, d), 20.0)


@query(SQL["investment_exact"])
def investment_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The same choice by branch and bound."""
    return bounded_investment(*_columns(spark, d), 20.0)


@query(f"""WITH {_COLUMNS}, sets AS (SELECT m AS mask, CAST(list_sum([CASE WHEN m & (1 << i) > 0 THEN 2e0 + i * 5 % 7 ELSE 0e0 END for i in range(9)]) AS DOUBLE) AS cost, coalesce(array_to_string([CASE WHEN m & (1 << i) > 0 THEN 'p' || i END for i in range(9)], ','), '') AS projects FROM range(512) t(m)),
served AS (SELECT DISTINCT mask, od FROM sets JOIN needs ON mask & need = need WHERE cost <= 20), sums AS (SELECT mask, sum(weight) AS weight, count(*) AS ods FROM served JOIN weights USING (od) GROUP BY 1)
SELECT CAST(budget AS DOUBLE) AS budget, projects, cost, coalesce(weight, 0e0) AS weight, coalesce(ods, 0) AS ods FROM sets LEFT JOIN sums USING (mask) JOIN (VALUES (8), (14), (20)) v(budget) ON cost <= budget QUALIFY row_number() OVER (PARTITION BY budget ORDER BY coalesce(weight, 0e0) DESC, cost, projects) = 1""")
def budget_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The best set of projects at three budgets."""
    return I.budget_comparison(*_columns(spark, d), [8.0, 14.0, 20.0])


#: The best next option from every set of projects built so far (a number of nine bits), and the walk along them.
_GREEDY = f"""{_COLUMNS}, least AS (SELECT od, list(need ORDER BY need) AS sig FROM needs n WHERE NOT EXISTS (SELECT 1 FROM needs o WHERE o.od = n.od AND o.need <> n.need AND o.need & n.need = o.need) GROUP BY 1), sigs AS (SELECT sig, sum(weight) AS weight FROM least JOIN weights USING (od) GROUP BY 1),
costs AS (SELECT m AS mask, CAST(list_sum([CASE WHEN m & (1 << i) > 0 THEN 2e0 + i * 5 % 7 ELSE 0e0 END FOR i IN range(9)]) AS DOUBLE) AS cost, list_filter([CASE WHEN m & (1 << i) > 0 THEN 'p' || i END FOR i IN range(9)], lambda x: x IS NOT NULL) AS names FROM range(512) t(m)),
unserved AS (SELECT mask, sig, weight FROM costs, sigs WHERE cost <= 20 AND len(list_filter(sig, lambda n: n & mask = n)) = 0), options AS (SELECT mask, 1 << i AS opt FROM costs, range(9) t(i) WHERE mask & (1 << i) = 0 {{packages}}),
gains AS (SELECT o.mask, opt, sum(weight) AS gain FROM options o JOIN unserved u ON u.mask = o.mask WHERE len(list_filter(sig, lambda n: n & (o.mask | opt) = n)) > 0 GROUP BY 1, 2),
best AS (SELECT g.mask, opt, gain, c.cost AS cost, c.names AS names FROM gains g JOIN costs c ON c.mask = opt JOIN costs b ON b.mask = g.mask WHERE b.cost + c.cost <= 20 AND gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY g.mask ORDER BY gain / c.cost DESC, gain DESC, c.cost, c.names DESC) = 1),
walk(step, mask, projects, spent, gain, total) AS (SELECT 0, CAST(0 AS BIGINT), '', 0e0, 0e0, 0e0 UNION ALL SELECT step + 1, w.mask | opt, array_to_string(names, ','), spent + cost, CAST(b.gain AS DOUBLE), total + b.gain FROM walk w JOIN best b USING (mask))
SELECT step, projects, spent, gain, total FROM walk WHERE step > 0"""


@query("WITH RECURSIVE " + _GREEDY.format(packages=""))
def investment_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Projects in the order of what each next one newly serves for its cost."""
    return I.greedy_investment(*_columns(spark, d), 20.0)


@query("WITH RECURSIVE " + _GREEDY.format(packages="UNION SELECT mask, unnest(list_transform(sig, lambda n: n & ~mask)) FROM unserved"))
def investment_greedy_packages(spark: SparkSession, d: str) -> DataFrame:
    """The same, where what a route still lacks may be built at once."""
    return I.greedy_investment(*_columns(spark, d), 20.0, packages=True)


def _greedy_cover_sql(k: int) -> str:
    """k steps written out: what is covered and what is too close after each."""
    parts = ["a AS (SELECT c_custkey AS a, (c_custkey * 7919 % 10007)::DOUBLE AS ax, (c_custkey * 104729 % 10009)::DOUBLE AS ay, 1e0 + c_custkey % 5 AS weight FROM customer), b AS (SELECT s_suppkey AS b, (s_suppkey * 7919 % 10007)::DOUBLE AS bx, (s_suppkey * 104729 % 10009)::DOUBLE AS by_ FROM supplier)",
             "p0 AS (SELECT a, b, weight FROM a, b WHERE sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)) <= 1500), b0 AS (SELECT * FROM b)"]
    for i in range(1, k + 1):
        parts.append(f"s{i} AS (SELECT {i} AS step, b, sum(weight) AS gain FROM p{i - 1} JOIN b{i - 1} USING (b) GROUP BY b ORDER BY gain DESC, b LIMIT 1)")
        parts.append(f"p{i} AS (SELECT * FROM p{i - 1} WHERE a NOT IN (SELECT a FROM p{i - 1} JOIN s{i} USING (b))), b{i} AS (SELECT o.* FROM b{i - 1} o, s{i} JOIN b c ON c.b = s{i}.b WHERE o.b <> c.b AND sqrt(pow(o.bx - c.bx, 2) + pow(o.by_ - c.by_, 2)) >= 1000)")
    steps = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, k + 1))
    return f"WITH {', '.join(parts)} SELECT CAST(step AS INTEGER) AS step, b AS site, gain, sum(gain) OVER (ORDER BY step) AS total FROM ({steps})"


@query(_greedy_cover_sql(6))
def facility_cover_greedy(spark: SparkSession, d: str) -> DataFrame:
    demand = X.points(spark, d, "customer", "c_custkey").toDF("a", "ax", "ay").withColumn("weight", 1.0 + F.col("a") % 5)
    return I.greedy_cover(X.points(spark, d, "supplier", "s_suppkey").toDF("b", "bx", "by"), demand, 6, 1500.0, 1000.0)


@query(f"""WITH RECURSIVE a AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_suppkey AS id, (s_suppkey * 7919 % 10007)::DOUBLE AS x, (s_suppkey * 104729 % 10009)::DOUBLE AS y FROM supplier),
walk(n, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) UNION ALL SELECT a.n, CASE WHEN len(list_filter(kept, lambda k: (k.x - a.x) * (k.x - a.x) + (k.y - a.y) * (k.y - a.y) < 1440000)) > 0 THEN kept ELSE list_append(kept, {{'id': a.id, 'x': a.x, 'y': a.y}}) END FROM walk JOIN a ON a.n = walk.n + 1)
SELECT k.id, k.x, k.y FROM (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1))""")
def sites_apart(spark: SparkSession, d: str) -> DataFrame:
    """Sites that remain when each closer than 1,200 m to an earlier one that remains goes."""
    return I.first_apart(X.points(spark, d, "supplier", "s_suppkey"), 1200.0)
