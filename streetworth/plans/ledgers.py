"""The commute ledger under five scenarios, choice sets and their users, uncertain draws, and evidence on candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.functions import columns as C
from streetworth.operators import relational as R
from streetworth.operators import selection as S
from streetworth.operators.graph import _save
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table, with_
from streetworth.plans.selection import _GAINS
from streetworth.queries import _ACTIVITY, _CELLS, _PROBABILITY, _SAVINGS, _activity, _cells
from streetworth.registry import query

TARGET = 0.5


def scenario_ledger(units: DataFrame, target: float, eligible: float, observed: float) -> DataFrame:
    """units(od, eligible, observed, distance_km, gradient, status) under baseline, three propensity scenarios and a target share: one row for each scenario and unit.

    Users are at least those observed and at most those eligible. The target asks for `target` of the whole market's `eligible` less its `observed`, also where units of it are not routed:
    what is missing is shared over the assigned units by room * propensity * distance decay. Units that are not assigned stay, without users.
    """
    ok = F.col("status") == "assigned"
    rows = units.withColumn("room", F.when(ok, F.greatest(F.lit(0.0), F.col("eligible") - F.col("observed"))).otherwise(0.0))
    for name in C.PROPENSITY:
        rows = rows.withColumn(name, C.propensity(name, F.col("distance_km"), F.col("gradient")))
    rows = rows.withColumn("weight", F.col("room") * F.col("ebike") * C.distance_decay(F.col("distance_km")))
    filled = R.water_fill(rows, [], "weight", "room", F.lit(max(0.0, target * eligible - observed)))
    found = [("baseline", F.col("observed"), F.lit(None).cast("double"))]
    found += [(n, F.least("eligible", F.greatest("observed", F.col("eligible") * F.col(n))), F.col(n)) for n in C.PROPENSITY]
    found += [("target", F.col("observed") + F.col("given"), F.col("ebike"))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.when(ok, u).alias("users"), F.when(ok, p).alias("propensity")) for n, u, p in found]))
    return filled.select("od", "eligible", "observed", "status", each.alias("s")).select("s.scenario", "od", "eligible", "observed", "s.users", (F.col("s.users") - F.col("observed")).alias("additional"), "s.propensity", "status")


_UNITS = """units AS (SELECT o_orderkey AS od, coalesce(eligible, 10e0) AS eligible, coalesce(base, 0e0) AS observed, 1 + o_orderkey % 40 * 0.9e0 AS distance_km, o_orderkey % 7 * 0.5e0 AS gradient, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'assigned' END AS status FROM orders LEFT JOIN ods ON od = o_orderkey)"""
_ETA = "{a} + {d1} * least(distance_km, 30e0) + 1.988e0 * sqrt(least(distance_km, 30e0)) + 0.008775e0 * pow(least(distance_km, 30e0), 2) + {d2} * pow(least(distance_km, 30e0), 2) + ({g} + 0.02006e0 * least(distance_km, 30e0) - 0.1234e0 * sqrt(least(distance_km, 30e0))) * (gradient - 0.78e0)"
_PS = {"government": ("-4.018e0", "-0.6369e0", "0e0", "-0.2555e0"), "go_dutch": ("-1.468e0", "-0.71726e0", "0e0", "-0.2555e0"), "ebike": ("-1.468e0", "-0.66217e0", "-0.000295e0", "-0.0743e0")}
_LEDGER = _UNITS + ", propensities AS (SELECT *, " + ", ".join(f"1 / (1 + exp(-({_ETA.format(a=a, d1=d1, d2=d2, g=g)}))) AS {n}" for n, (a, d1, d2, g) in _PS.items()) + f""" FROM units),
roomy AS (SELECT *, CASE WHEN status = 'assigned' THEN greatest(0e0, eligible - observed) ELSE 0e0 END AS room FROM propensities), weighed AS (SELECT *, room * ebike * (CASE WHEN distance_km <= 12 THEN 1e0 ELSE exp(-(distance_km - 12) / 5) END) AS w FROM roomy),
asked AS (SELECT greatest(0e0, {TARGET}e0 * sum(eligible) - sum(observed)) AS t FROM units),
levels AS (SELECT *, CASE WHEN w > 0 THEN (t - (sum(CASE WHEN w > 0 THEN room ELSE 0e0 END) OVER k - room)) / (sum(w) OVER () - sum(w) OVER k + w) END AS level FROM weighed, asked WINDOW k AS (ORDER BY CASE WHEN w > 0 THEN room / w ELSE -1e0 END, od ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (SELECT *, CASE WHEN w > 0 THEN least(room, greatest(0e0, max(level) OVER ()) * w) ELSE 0e0 END AS given FROM levels),
ledger AS (SELECT scenario, od, eligible, observed, status, CASE WHEN status <> 'assigned' THEN NULL WHEN scenario = 'baseline' THEN observed WHEN scenario = 'target' THEN observed + given ELSE least(eligible, greatest(observed, eligible * (CASE scenario WHEN 'government' THEN government WHEN 'go_dutch' THEN go_dutch ELSE ebike END))) END AS users,
  CASE WHEN status = 'assigned' THEN CASE scenario WHEN 'government' THEN government WHEN 'go_dutch' THEN go_dutch WHEN 'ebike' THEN ebike WHEN 'target' THEN ebike END END AS propensity FROM filled CROSS JOIN (VALUES ('baseline'), ('government'), ('go_dutch'), ('ebike'), ('target')) v(scenario))"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a unit; orders in state P found no way."""
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(o.alias("od"), (1 + o % 40 * 0.9).alias("distance_km"), (o % 7 * 0.5).alias("gradient"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("assigned").alias("status"))
    units = orders.join(X.ods(spark, d), "od", "left").withColumnRenamed("base", "observed").fillna({"eligible": 10.0, "observed": 0.0})
    market = units.agg(F.sum("eligible"), F.sum("observed")).first()
    return scenario_ledger(units, TARGET, market[0] or 0.0, market[1] or 0.0)


@query(with_("ods", f", {_LEDGER} SELECT scenario, od, status, round(users, 5) AS users, round(users - observed, 5) AS additional, round(propensity, 8) AS propensity FROM ledger"))
def commute_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("scenario", "od", "status", F.round("users", 5).alias("users"), F.round("additional", 5).alias("additional"), F.round("propensity", 8).alias("propensity"))


@query(with_("ods", f""", {_LEDGER} SELECT scenario, round(sum(users), 3) AS users, round(sum(users - observed), 3) AS additional, count(users) AS assigned, CASE WHEN scenario = 'target' THEN round(any_value(t), 3) END AS asked,
CASE WHEN scenario = 'target' THEN round(greatest(0e0, any_value(t) - sum(users - observed)), 3) END AS unallocated FROM ledger, asked GROUP BY 1"""))
def scenario_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Sums of each scenario; of the target also what it asked for over the whole market and what the routed part could not take."""
    rows = ledger(spark, d)
    market = rows.where("scenario = 'baseline'").agg(F.greatest(F.lit(0.0), TARGET * F.sum("eligible") - F.sum("observed")).alias("t"))
    sums = rows.groupBy("scenario").agg(F.sum("users").alias("users"), F.sum("additional").alias("additional"), F.count("users").alias("assigned")).crossJoin(market)  # one row
    own = F.col("scenario") == "target"
    left = F.greatest(F.lit(0.0), F.col("t") - F.col("additional"))
    return sums.select("scenario", F.round("users", 3).alias("users"), F.round("additional", 3).alias("additional"), "assigned", F.when(own, F.round("t", 3)).alias("asked"), F.when(own, F.round(left, 3)).alias("unallocated"))


@query(f"""WITH {_CELLS}, el AS (SELECT origin, destination, n, lower, CASE WHEN n = -999 THEN 0e0 ELSE point END AS point, upper FROM held), m AS (SELECT c_nationkey AS origin, 3e0 + count(*) % 9 AS e FROM customer GROUP BY 1),
c AS (SELECT origin, destination, least(lower, e) AS lower, least(point, e) AS point, least(upper, e + 2) AS upper, e FROM el JOIN m USING (origin))
SELECT origin, destination, lower, point, upper, round(least(lower + 0.25e0 * (upper - lower), e - 2 + 0.5e0 * 4), 8) AS drawn FROM c""")
def joint_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of cyclists held within those of people: point and lower bound by the people's point, the upper bound by their upper one; and a joint draw of both at fixed shares of their intervals."""
    people = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("origin")).agg((3.0 + F.count("*") % 9).alias("e"))
    rows = _cells(spark, d).withColumn("point", F.when(F.col("n") == -999, 0.0).otherwise(F.col("point"))).join(people, "origin")
    e = F.col("e")
    rows = rows.select("origin", "destination", F.least("lower", e).alias("lower"), F.least("point", e).alias("point"), F.least(F.col("upper"), e + 2).alias("upper"), "e")
    drawn = F.least(F.col("lower") + 0.25 * (F.col("upper") - F.col("lower")), e - 2 + 0.5 * 4)
    return rows.select("origin", "destination", "lower", "point", "upper", F.round(drawn, 8).alias("drawn"))


_DECILES = "poor AS (SELECT o_orderkey AS od FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN (SELECT min(c_mktsegment) FROM customer))"


@query(with_("path_edges paths ods project_edges", f""", {_ACTIVITY}, {_DECILES}, m AS (SELECT candidate, a.od, improvement, addition, poor.od IS NOT NULL AS poor FROM added a LEFT JOIN poor ON poor.od = a.od)
SELECT candidate, count(*) FILTER (poor) AS ods, round(sum(improvement) FILTER (poor), 4) AS improvement, round(sum(addition) FILTER (poor), 4) AS addition, round(sum(addition) FILTER (poor) * 1.3e0 * 220 * 2, 2) AS annual_km FROM m GROUP BY 1"""))
def equity_activity(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's value for journeys that start in the most deprived supports (here: of the first market segment)."""
    customers = table(spark, d, "customer")
    first = customers.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    poor = table(spark, d, "orders").join(customers.join(first, "c_mktsegment", "left_semi"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("od"))
    added = _activity(spark, d)
    names = added.groupBy("candidate").agg(F.count("*").alias("_n"))
    sums = added.join(poor, "od", "left_semi").groupBy("candidate").agg(F.count("*").alias("ods"), F.sum("improvement").alias("improvement"), F.sum("addition").alias("addition"))
    rows = names.join(sums, "candidate", "left").fillna(0, ["ods"])
    return rows.select("candidate", "ods", F.round("improvement", 4).alias("improvement"), F.round("addition", 4).alias("addition"), F.round(F.col("addition") * 1.3 * 220 * 2, 2).alias("annual_km"))


@query(with_("path_edges paths ods project_edges", f""", {_ACTIVITY}, used AS (SELECT DISTINCT candidate, od, path FROM path_edges JOIN project_edges USING (edge)),
u AS (SELECT candidate, od, sum(probability) AS p, sum(probability * exp(0.05e0 * coalesce(saving, 0e0))) AS e FROM used JOIN probs USING (od, path) LEFT JOIN savings USING (candidate, od, path) GROUP BY 1, 2)
SELECT candidate, round(sum(base * least(1e0, p)), 4) AS before, round(sum((base + addition) * least(1e0, e / (1 + more))), 4) AS after, round(sum((base + addition) * least(1e0, e / (1 + more)) - base * least(1e0, p)), 4) AS additional
FROM u JOIN grouped USING (candidate, od) JOIN (SELECT candidate, od, addition, base FROM added) USING (candidate, od) GROUP BY 1"""))
def treatment_usage_after(spark: SparkSession, d: str) -> DataFrame:
    """Users of each candidate's edges before and after it is built: demand grows, and choice moves to the paths it improves."""
    edges, theta = X.path_edges(spark, d), X.THETA
    on = X.project_edges(spark, d)
    paths = R.path_probabilities(X.paths(edges), theta)
    savings = R.path_savings(edges, on)
    used = edges.join(on, "edge").select("candidate", "od", "path").distinct()
    grown = F.col("probability") * F.exp(theta * F.coalesce("saving", F.lit(0.0)))
    shares = used.join(paths.select("od", "path", "probability"), ["od", "path"]).join(savings, ["candidate", "od", "path"], "left")
    shares = shares.groupBy("candidate", "od").agg(F.sum("probability").alias("p"), F.sum(grown).alias("e"), F.sum(grown - F.col("probability")).alias("more"))
    met = shares.join(_activity(spark, d).select("candidate", "od", "addition"), ["candidate", "od"]).join(X.ods(spark, d), "od")
    before = F.col("base") * F.least(F.lit(1.0), F.col("p"))
    after = (F.col("base") + F.col("addition")) * F.least(F.lit(1.0), F.col("e") / (1 + F.col("more")))
    return met.groupBy("candidate").agg(F.round(F.sum(before), 4).alias("before"), F.round(F.sum(after), 4).alias("after"), F.round(F.sum(after - before), 4).alias("additional"))


#: Factors of one draw: six on demand and one each on cost, value and discounting, from its number by fixed steps.
_SPREAD = {"suppression": (37, 0.9, 1.1), "uptake": (53, 0.7, 1.3), "routes": (71, 0.8, 1.1), "growth": (29, 0.9, 1.4), "induced": (61, 0.95, 1.2), "season": (83, 0.9, 1.05), "cost": (43, 0.8, 1.6), "value": (97, 0.6, 1.5), "rate": (19, 0.02, 0.08)}
_ENSEMBLE = "draws AS (SELECT draw, " + ", ".join(f"{lo}e0 + (draw * {k} % 101) / 100e0 * ({hi}e0 - {lo}e0) AS {n}" for n, (k, lo, hi) in _SPREAD.items()) + """ FROM (SELECT unnest(range(1, 101)) AS draw)),
factors AS (SELECT d.*, sum(least(1e0, y / 3e0) * pow(1 + rate, -y)) AS benefit_factor, sum((0.0125e0 + CASE WHEN y = 20 THEN 0.125e0 ELSE 0e0 END - CASE WHEN y = 40 THEN 0.05e0 ELSE 0e0 END) * pow(1 + rate, -y)) AS cost_factor FROM draws d, (SELECT unnest(range(1, 41)) AS y) GROUP BY ALL),
ensemble AS (SELECT candidate, draw, least(km * 4.9e0, users * 6200e0) * suppression * uptake * routes * growth * induced * season * value * benefit_factor AS benefit, p.cost * f.cost * (1 + cost_factor) AS paid FROM projects p CROSS JOIN factors f)"""


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    """(candidate, draw, benefit, paid): present values of every candidate under each of 100 draws of nine factors. Factors of a draw are literals' arithmetic, so the cross is an explode."""
    factor = lambda n: _SPREAD[n][1] + (F.col("draw") * _SPREAD[n][0] % 101) / 100.0 * (_SPREAD[n][2] - _SPREAD[n][1])
    rate = factor("rate")
    years = F.sequence(F.lit(1), F.lit(40))
    off = lambda y: F.pow(1 + rate, -y.cast("double"))
    benefit = F.aggregate(years, F.lit(0.0), lambda s, y: s + F.least(F.lit(1.0), y / 3) * off(y))
    cost = F.aggregate(years, F.lit(0.0), lambda s, y: s + (0.0125 + F.when(y == 20, 0.125).otherwise(0.0) - F.when(y == 40, 0.05).otherwise(0.0)) * off(y))
    demand = factor("suppression") * factor("uptake") * factor("routes") * factor("growth") * factor("induced") * factor("season") * factor("value")
    draws = spark.range(1, 101).select(F.col("id").cast("int").alias("draw")).select("draw", (demand * benefit).alias("gain"), (factor("cost") * (1 + cost)).alias("price"))
    rows = X.projects(spark, d).crossJoin(F.broadcast(draws))  # 100 rows
    return rows.select("candidate", "draw", (F.least(F.col("km") * 4.9, F.col("users") * 6200.0) * F.col("gain")).alias("benefit"), (F.col("cost") * F.col("price")).alias("paid"))


_RANKED = """, ranked AS (SELECT *, benefit / paid AS bcr, row_number() OVER (PARTITION BY draw ORDER BY round(benefit / paid, 10) DESC, candidate) AS rank FROM ensemble), best AS (SELECT draw, paid, max(benefit) AS best FROM ensemble GROUP BY 1, 2),
run AS (SELECT *, max(best) OVER (PARTITION BY draw ORDER BY paid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)"""


@query(with_("projects", f""", {_ENSEMBLE}{_RANKED} SELECT candidate, round(avg(bcr), 8) AS mean, round(quantile_cont(bcr, 0.05), 8) AS p05, round(quantile_cont(bcr, 0.5), 8) AS p50, round(quantile_cont(bcr, 0.95), 8) AS p95, round(quantile_cont(benefit - paid, 0.5), 3) AS npv_p50, round(avg(rank), 6) AS mean_rank,
round(avg(CASE WHEN bcr >= 1 THEN 1e0 ELSE 0e0 END), 6) AS worth, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END), 6) AS in_top, round(avg(CASE WHEN benefit = best AND (before IS NULL OR benefit > before) THEN 1e0 ELSE 0e0 END), 6) AS on_frontier FROM ranked JOIN run USING (draw, paid) GROUP BY 1"""))
def uncertainty_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Candidates over all draws: ratio of benefit to cost with its quantiles, rank, and how often each is worth its cost, among the first five and on the frontier."""
    rows = _save(ensemble(spark, d).withColumn("bcr", F.col("benefit") / F.col("paid")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc(F.round("bcr", 10)), "candidate")))
    on = R.pareto(ranked, "paid", "benefit", ["draw"])
    at = lambda c, p, n: F.round(F.percentile(c, F.lit(p)), n)
    often = lambda x: F.round(F.avg(x.cast("double")), 6)
    return on.groupBy("candidate").agg(
        F.round(F.avg("bcr"), 8).alias("mean"), at("bcr", 0.05, 8).alias("p05"), at("bcr", 0.5, 8).alias("p50"), at("bcr", 0.95, 8).alias("p95"), at(F.col("benefit") - F.col("paid"), 0.5, 3).alias("npv_p50"),
        F.round(F.avg("rank"), 6).alias("mean_rank"), often(F.col("bcr") >= 1).alias("worth"), often(F.col("rank") <= 5).alias("in_top"), often(F.col("efficient")).alias("on_frontier"),
    )


@query(with_("path_edges paths ods project_edges projects", f""", {_ACTIVITY}, {_GAINS}, {_ENSEMBLE}, sums AS (SELECT candidate, sum(addition) AS addition, count(*) AS ods FROM added GROUP BY 1), risk AS (SELECT candidate, avg(CASE WHEN benefit >= paid THEN 1e0 ELSE 0e0 END) AS worth FROM ensemble GROUP BY 1),
top AS (SELECT candidate, max(gain) / sum(gain) AS largest FROM gains GROUP BY 1)
SELECT candidate, round(addition, 4) AS addition, ods, round(cost, 2) AS cost, round(worth, 6) AS worth, round(largest, 8) AS largest_cell, CASE WHEN sums.candidate IS NULL THEN 'no_demand' WHEN worth >= 0.75e0 AND largest < 0.5e0 THEN 'robust' WHEN worth >= 0.5e0 THEN 'likely' ELSE 'weak' END AS evidence
FROM projects LEFT JOIN sums USING (candidate) LEFT JOIN risk USING (candidate) LEFT JOIN top USING (candidate)"""))
def evidence_profiles(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each candidate: demand, its spread over source cells, cost, and how it stands over the draws."""
    activity = _activity(spark, d)
    cells = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("od"), F.col("c_nationkey").alias("cell"))
    sums = activity.groupBy("candidate").agg(F.sum("addition").alias("addition"), F.count("*").alias("ods"))
    top = activity.join(cells, "od").groupBy("candidate", "cell").agg(F.sum("addition").alias("gain")).groupBy("candidate").agg((F.max("gain") / F.sum("gain")).alias("largest"))
    risk = ensemble(spark, d).groupBy("candidate").agg(F.avg((F.col("benefit") >= F.col("paid")).cast("double")).alias("worth"))
    rows = X.projects(spark, d).select("candidate", "cost").join(sums, "candidate", "left").join(risk, "candidate", "left").join(top, "candidate", "left")
    kind = F.when(F.col("ods").isNull(), "no_demand").when((F.col("worth") >= 0.75) & (F.col("largest") < 0.5), "robust").when(F.col("worth") >= 0.5, "likely").otherwise("weak")
    return rows.select("candidate", F.round("addition", 4).alias("addition"), "ods", F.round("cost", 2).alias("cost"), F.round("worth", 6).alias("worth"), F.round("largest", 8).alias("largest_cell"), kind.alias("evidence"))


@query(with_("path_edges paths ods project_edges projects", f""", {_PROBABILITY}, {_SAVINGS}, ordered AS (SELECT candidate, row_number() OVER (ORDER BY round(users / cost, 10) DESC, candidate) AS step FROM projects), steps AS (SELECT unnest(range(1, 6)) AS prefix),
s AS (SELECT prefix, od, path, sum(saving) AS saving FROM savings JOIN ordered USING (candidate) JOIN steps ON step <= prefix GROUP BY 1, 2, 3), g AS (SELECT prefix, od, sum(probability * (exp(0.05e0 * saving) - 1)) AS more FROM s JOIN probs USING (od, path) GROUP BY 1, 2),
c AS (SELECT od, sum(probability * cost) AS expected FROM probs GROUP BY 1), j AS (SELECT prefix, eligible, base, expected, expected - ln(1 + more) / 0.05e0 AS after, greatest(1e-5, least(base / eligible, 1 - 1e-5)) AS sh FROM g JOIN c USING (od) JOIN ods USING (od))
SELECT prefix, count(*) AS ods, round(sum(CASE WHEN after >= expected THEN 0e0 ELSE greatest(0e0, least(eligible * (1 / (1 + exp(-(ln(sh / (1 - sh)) + 0.6e0 * ln(expected / after)))) - base / eligible), eligible - base)) END), 3) AS addition FROM j GROUP BY 1"""))
def prefix_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The first one to five candidates of the build order, each prefix valued as a whole: savings of a path add up over its candidates."""
    edges, theta = X.path_edges(spark, d), X.THETA
    paths = R.path_probabilities(X.paths(edges), theta)
    order = R.carried(X.projects(spark, d), [F.desc(F.round(F.col("users") / F.col("cost"), 10)), F.col("candidate")], F.lit(1), "step").where("step <= 5").select("candidate", F.explode(F.sequence(F.col("step"), F.lit(5))).alias("prefix"))
    saved = R.path_savings(edges, X.project_edges(spark, d)).join(order, "candidate").groupBy(F.col("prefix").cast("string").alias("candidate"), "od", "path").agg(F.sum("saving").alias("saving"))
    found = R.single_candidate_activity(saved, paths, X.ods(spark, d), theta, X.ELASTICITY)
    return found.groupBy(F.col("candidate").cast("long").alias("prefix")).agg(F.count("*").alias("ods"), F.round(F.sum("addition"), 3).alias("addition"))


@query(with_("ods", """, k AS (SELECT od, eligible, base, draw, 0.5e0 + (draw * 37 % 100) / 100e0 AS uptake, 0.8e0 + (draw * 53 % 100) / 250e0 AS suppression FROM ods CROSS JOIN (SELECT unnest(range(1, 17)) AS draw))
SELECT draw, round(sum(least(eligible, base * suppression)), 3) AS observed, round(sum(least(eligible, greatest(least(eligible, base * suppression), eligible * 0.3e0 * uptake))), 3) AS users FROM k GROUP BY 1"""))
def uncertain_flows(spark: SparkSession, d: str) -> DataFrame:
    """Demand under 16 draws: suppressed counts scaled, uptake scaled, nobody counted who is not eligible."""
    rows = X.ods(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(16))))
    seen = F.least(F.col("eligible"), F.col("base") * (0.8 + (F.col("draw") * 53 % 100) / 250.0))
    users = F.least(F.col("eligible"), F.greatest(seen, F.col("eligible") * 0.3 * (0.5 + (F.col("draw") * 37 % 100) / 100.0)))
    return rows.groupBy(F.col("draw").cast("long").alias("draw")).agg(F.round(F.sum(seen), 3).alias("observed"), F.round(F.sum(users), 3).alias("users"))


@query(with_("path_edges paths ods project_edges projects", f""", {_ACTIVITY}, m AS (SELECT scenario, candidate, sum(addition * f) AS gain FROM added CROSS JOIN (VALUES ('network', 1e0), ('appraisal', 2e0), ('access', 0.5e0)) v(scenario, f) GROUP BY 1, 2), c AS (SELECT scenario, candidate, gain, cost FROM m JOIN projects USING (candidate)),
b AS (SELECT scenario, cost, max(gain) AS best FROM c GROUP BY 1, 2), r AS (SELECT *, max(best) OVER (PARTITION BY scenario ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
s AS (SELECT scenario, candidate, cost, gain, row_number() OVER (PARTITION BY scenario ORDER BY round(gain / cost, 12) DESC, candidate) AS step FROM c), p AS (SELECT *, sum(cost) OVER (PARTITION BY scenario ORDER BY step) AS spent FROM s)
SELECT scenario, candidate, step, round(spent, 2) AS spent, gain = best AND (before IS NULL OR gain > before) AS efficient FROM p JOIN r USING (scenario, cost)"""))
def portfolio_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Every analysis of the portfolio in one ledger: candidates in build order with running cost, and whether each is on its analysis' frontier."""
    gains = _activity(spark, d).groupBy("candidate").agg(F.sum("addition").alias("g")).join(X.projects(spark, d).select("candidate", "cost"), "candidate")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("f")) for n, f in (("network", 1.0), ("appraisal", 2.0), ("access", 0.5))]))
    rows = _save(gains.select("candidate", "cost", "g", each.alias("s")).select("s.scenario", "candidate", "cost", (F.col("g") * F.col("s.f")).alias("gain")))
    own = Window.partitionBy("scenario").orderBy(F.desc(F.round(F.col("gain") / F.col("cost"), 12)), "candidate")  # as long as the list of candidates
    rows = rows.withColumns({"step": F.row_number().over(own).cast("long"), "spent": F.sum("cost").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return R.pareto(rows, "cost", "gain", ["scenario"]).select("scenario", "candidate", "step", F.round("spent", 2).alias("spent"), "efficient")


@query(with_("path_edges paths ods project_edges projects", f""", {_ACTIVITY}, m AS (SELECT candidate, sum(addition) AS gain FROM added GROUP BY 1), c AS (SELECT candidate, gain, cost, row_number() OVER (ORDER BY round(gain / cost, 12) DESC, candidate) AS step FROM m JOIN projects USING (candidate)),
p AS (SELECT candidate FROM c WHERE step <= 8), e AS (SELECT candidate FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.cost <= a.cost AND b.gain >= a.gain AND (b.cost < a.cost OR b.gain > a.gain))) SELECT candidate FROM p UNION SELECT candidate FROM e"""))
def initial_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What a first view shows: all steps of the portfolio and all members of the frontier, each once."""
    rows = _save(_activity(spark, d).groupBy("candidate").agg(F.sum("addition").alias("gain")).join(X.projects(spark, d).select("candidate", "cost"), "candidate"))
    steps = R.carried(rows, [F.desc(F.round(F.col("gain") / F.col("cost"), 12)), F.col("candidate")], F.lit(1), "step").where("step <= 8").select("candidate")
    return steps.union(S.pareto_many(rows, "candidate", ["gain"], ["cost"]).where("efficient").select("candidate")).distinct()
