"""Registry of the library's queries over the driver's tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.functions import columns as C
from streetworth.operators import graph as G
from streetworth.operators import relational as R
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table, with_
from streetworth.registry import QUERIES, SQL, query  # noqa: F401


_PROBABILITY = "probs AS (SELECT od, path, cost, exp(-0.05e0 * cost - m) / sum(exp(-0.05e0 * cost - m)) OVER (PARTITION BY od) AS probability FROM (SELECT *, max(-0.05e0 * cost) OVER (PARTITION BY od) AS m FROM paths))"
_SAVINGS = "savings AS (SELECT od, path, candidate, sum(cost * (1 - keep)) AS saving FROM path_edges JOIN project_edges USING (edge) GROUP BY 1, 2, 3)"
_ACTIVITY = f"""{_PROBABILITY}, {_SAVINGS},
grouped AS (SELECT candidate, od, sum(probability * (exp(0.05e0 * saving) - 1)) AS more FROM savings JOIN probs USING (od, path) GROUP BY 1, 2),
costs AS (SELECT od, sum(probability * cost) AS expected FROM probs GROUP BY 1),
joined AS (SELECT g.*, expected, expected - ln(1 + more) / 0.05e0 AS after, eligible, base FROM grouped g JOIN costs USING (od) JOIN ods USING (od)),
share AS (SELECT *, greatest(1e-5, least(base / eligible, 1 - 1e-5)) AS s FROM joined),
added AS (SELECT *, CASE WHEN after >= expected THEN 0e0 ELSE greatest(0e0, least(eligible * (1 / (1 + exp(-(ln(s / (1 - s)) + 0.6e0 * ln(expected / after)))) - base / eligible), eligible - base)) END AS addition,
  eligible * (expected - after) / expected AS improvement FROM share)"""


def _activity(spark: SparkSession, d: str) -> DataFrame:
    edges = X.path_edges(spark, d)
    paths = R.path_probabilities(X.paths(edges), X.THETA)
    return R.single_candidate_activity(R.path_savings(edges, X.project_edges(spark, d)), paths, X.ods(spark, d), X.THETA, X.ELASTICITY)


@query(with_("path_edges paths ods projects project_edges", f""", {_ACTIVITY},
sums AS (SELECT candidate, sum(addition) AS addition, count(*) FILTER (after < expected) AS affected FROM added GROUP BY 1),
priced AS MATERIALIZED (SELECT candidate, cost, addition, affected FROM sums JOIN projects USING (candidate)),
best AS MATERIALIZED (SELECT cost, max(addition) AS best FROM priced GROUP BY 1),
run AS (SELECT *, max(best) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)
SELECT candidate, round(cost, 2) AS cost, round(addition, 4) AS addition, affected, addition = best AND (before IS NULL OR addition > before) AS efficient FROM priced JOIN run USING (cost)"""))
def candidate_activity_addition(spark: SparkSession, d: str) -> DataFrame:
    sums = _activity(spark, d).groupBy("candidate").agg(F.sum("addition").alias("addition"), F.count_if(F.col("after") < F.col("expected")).alias("affected"))
    priced = sums.join(X.projects(spark, d).select("candidate", "cost"), "candidate")
    return R.pareto(priced, "cost", "addition").select("candidate", F.round("cost", 2).alias("cost"), F.round("addition", 4).alias("addition"), "affected", "efficient")


@query(with_("path_edges paths ods project_edges", f", {_ACTIVITY} SELECT candidate, round(sum(improvement), 4) AS improvement, count(*) AS ods FROM added GROUP BY 1"))
def candidate_impedance_improvement(spark: SparkSession, d: str) -> DataFrame:
    return _activity(spark, d).groupBy("candidate").agg(F.round(F.sum("improvement"), 4).alias("improvement"), F.count("*").alias("ods"))


@query(with_("path_edges project_edges", f", {_SAVINGS} SELECT od, path, candidate, round(saving, 9) AS saving FROM savings"))
def path_candidate_savings(spark: SparkSession, d: str) -> DataFrame:
    return R.path_savings(X.path_edges(spark, d), X.project_edges(spark, d)).withColumn("saving", F.round("saving", 9))


@query("""SELECT CASE l_linestatus WHEN 'O' THEN 'commute' ELSE 'school' END AS purpose, l_partkey AS edge, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0e0 END), 4) AS observed,
round(sum(l_quantity), 4) AS eligible, count(*) AS records FROM lineitem GROUP BY 1, 2""")
def edge_flow_by_purpose(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("purpose", F.when(F.col("l_linestatus") == "O", "commute").otherwise("school"))
    observed = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return rows.groupBy("purpose", F.col("l_partkey").alias("edge")).agg(F.round(observed, 4).alias("observed"), F.round(F.sum("l_quantity"), 4).alias("eligible"), F.count("*").alias("records"))


@query(with_("path_edges", """, shared AS (SELECT *, count(*) OVER (PARTITION BY od, edge) AS n FROM path_edges),
sized AS (SELECT od, path, sum(cost) AS cost, greatest(1e-12, least(sum(cost / n) / sum(cost), 1e0)) AS path_size FROM shared GROUP BY 1, 2),
used AS (SELECT *, -0.002e0 * cost + ln(path_size) AS u FROM sized), top AS (SELECT *, max(u) OVER (PARTITION BY od) AS m FROM used)
SELECT od, path, round(path_size, 8) AS path_size, round(exp(u - m) / sum(exp(u - m)) OVER (PARTITION BY od), 8) AS probability FROM top"""))
def path_size_logit(spark: SparkSession, d: str) -> DataFrame:
    sized = R.path_size(X.path_edges(spark, d))
    chosen = R.path_probabilities(sized, 0.0, utility=-0.002 * F.col("cost") + F.log("path_size"))
    return chosen.select("od", "path", F.round("path_size", 8).alias("path_size"), F.round("probability", 8).alias("probability"))


@query("""SELECT o_orderkey AS od, o_orderpriority AS purpose, CASE WHEN n IS NULL THEN 'failed' ELSE 'assigned' END AS status, coalesce(n, 0) AS paths
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def od_ledger_complete(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("od")).agg(F.count_distinct("l_linenumber").alias("n"))
    joined = table(spark, d, "orders").select(F.col("o_orderkey").alias("od"), F.col("o_orderpriority").alias("purpose")).join(found, "od", "left")
    return joined.select("od", "purpose", F.when(F.col("n").isNull(), "failed").otherwise("assigned").alias("status"), F.coalesce("n", F.lit(0)).alias("paths"))


@query("""SELECT o_orderpriority AS purpose, count(*) AS ods, count(l.l_orderkey) AS assigned, round(sum(o_totalprice), 2) AS weighted, round(sum(CASE WHEN l.l_orderkey IS NULL THEN 0e0 ELSE o_totalprice END), 2) AS weighted_assigned,
round(1 - sum(CASE WHEN l.l_orderkey IS NULL THEN 0e0 ELSE o_totalprice END) / sum(o_totalprice), 8) AS failure_share FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l.l_orderkey GROUP BY 1""")
def coverage_by_purpose(spark: SparkSession, d: str) -> DataFrame:
    routed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("ok", F.lit(True))
    rows = table(spark, d, "orders").join(routed, "o_orderkey", "left").withColumn("got", F.when(F.col("ok"), F.col("o_totalprice")).otherwise(0.0))
    return rows.groupBy(F.col("o_orderpriority").alias("purpose")).agg(F.count("*").alias("ods"), F.count("ok").alias("assigned"), F.round(F.sum("o_totalprice"), 2).alias("weighted"), F.round(F.sum("got"), 2).alias("weighted_assigned"), F.round(1 - F.sum("got") / F.sum("o_totalprice"), 8).alias("failure_share"))


@query("""SELECT o_custkey AS stratum, o_orderkey AS od, rank, stratum_size, round(least(1e0, 3e0 / stratum_size), 8) AS inclusion, round(1 / least(1e0, 3e0 / stratum_size), 8) AS weight
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('20260301|' || o_custkey || '|' || o_orderkey), o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS stratum_size FROM orders) WHERE rank <= 3""")
def stratified_sample_ht(spark: SparkSession, d: str) -> DataFrame:
    chosen = R.stratified_sample(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3, "20260301")
    return chosen.select(F.col("o_custkey").alias("stratum"), F.col("o_orderkey").alias("od"), F.col("rank").cast("long").alias("rank"), "stratum_size", F.round("inclusion", 8).alias("inclusion"), F.round("weight", 8).alias("weight"))


@query("SELECT o_orderkey AS od, o_totalprice AS price FROM orders ORDER BY sha256('7:' || o_orderkey), o_orderkey LIMIT 100")
def hash_ordered_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("od"), F.col("o_totalprice").alias("price"))
    return rows.orderBy(F.sha2(F.concat(F.lit("7:"), F.col("od").cast("string")), 256), "od").limit(100)


_STRESS = """filled AS (SELECT *, coalesce(speed, CASE road_class WHEN 'motorway' THEN 100 WHEN 'arterial' THEN 60 WHEN 'collector' THEN 50 WHEN 'local' THEN 40 WHEN 'service' THEN 30 ELSE 20 END) AS v,
  coalesce(lanes, CASE road_class WHEN 'motorway' THEN 4 WHEN 'arterial' THEN 4 WHEN 'collector' THEN 2 WHEN 'local' THEN 2 ELSE 1 END) AS n,
  coalesce(traffic, CASE road_class WHEN 'motorway' THEN 30000 WHEN 'arterial' THEN 15000 WHEN 'collector' THEN 7000 WHEN 'local' THEN 3000 WHEN 'service' THEN 1000 ELSE 0 END) AS t FROM streets),
levels AS (SELECT *, CASE WHEN road_class = 'motorway' THEN 4 WHEN facility IN ('protected', 'shared') THEN 1
  WHEN facility = 'quiet_street' THEN CASE WHEN v <= 30 AND t <= 2000 THEN 1 WHEN v <= 40 THEN 2 ELSE 3 END
  WHEN facility = 'painted' THEN CASE WHEN v <= 40 AND n <= 2 AND t <= 6000 THEN 2 WHEN v <= 50 AND n <= 3 AND t <= 15000 THEN 3 ELSE 4 END
  ELSE CASE WHEN v <= 30 AND n <= 2 AND t <= 2000 THEN 1 WHEN v <= 40 AND n <= 2 AND t <= 4000 THEN 2 WHEN v <= 50 AND n <= 3 AND t <= 12000 THEN 3 ELSE 4 END END AS lts FROM filled)"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    rows = X.streets(spark, d)
    v, n, t = (C.assumed(F.col(c), F.col("road_class"), i) for i, c in enumerate(("speed", "lanes", "traffic")))
    return rows.withColumn("lts", C.stress_level(F.col("road_class"), F.col("facility"), v, n, t))


@query(with_("streets", f", {_STRESS} SELECT edge, CAST(lts AS INTEGER) AS lts, CAST((speed IS NULL)::INT + (lanes IS NULL)::INT + (traffic IS NULL)::INT AS INTEGER) AS imputed FROM levels"))
def lts_classification(spark: SparkSession, d: str) -> DataFrame:
    imputed = sum((F.col(c).isNull().cast("int") for c in ("lanes", "traffic")), F.col("speed").isNull().cast("int"))
    return _levels(spark, d).select("edge", F.col("lts").cast("int").alias("lts"), imputed.alias("imputed"))


@query(with_("streets", f""", {_STRESS} SELECT edge, round(length_m * (CASE lts WHEN 1 THEN 1e0 WHEN 2 THEN 1.2e0 WHEN 3 THEN 1.6e0 ELSE 2.2e0 END) * (1 + 4 * greatest(0e0, gradient) + 0.5e0 * greatest(0e0, -gradient))
* (CASE WHEN tunnel THEN 1.25e0 ELSE 1e0 END) * (CASE WHEN bridge THEN 1.05e0 ELSE 1e0 END), 6) AS generalized_cost FROM levels"""))
def comfort_cost(spark: SparkSession, d: str) -> DataFrame:
    cost = F.col("length_m") * C.comfort_multiplier(F.col("lts"), F.col("gradient"), F.col("tunnel"), F.col("bridge"))
    return _levels(spark, d).select("edge", F.round(cost, 6).alias("generalized_cost"))


_PCT = """SELECT s.scenario, round(sum(least(eligible, greatest(base, eligible / (1 + exp(-(a + d1 * d + 1.988e0 * sqrt(d) + d2 * d * d + (g1 + 0.02006e0 * d - 0.1234e0 * sqrt(d)) * (g - 0.78e0))))))), 3) AS users, count(*) AS ods, round(sum(base), 3) AS observed
FROM (SELECT *, least(1 + od % 40 * 0.9e0, 30e0) AS d, od % 7 * 0.5e0 AS g FROM ods) CROSS JOIN (VALUES ('government', -4.018e0, -0.6369e0, 0.008775e0, -0.2555e0), ('go_dutch', -4.018e0 + 2.550e0, -0.6369e0 - 0.08036e0, 0.008775e0, -0.2555e0),
('ebike', -4.018e0 + 2.550e0, -0.6369e0 - 0.08036e0 + 0.05509e0, 0.008775e0 - 0.000295e0, -0.2555e0 + 0.1812e0)) s(scenario, a, d1, d2, g1) GROUP BY 1"""


@query(with_("ods", _PCT))
def pct_scenarios(spark: SparkSession, d: str) -> DataFrame:
    rows = X.ods(spark, d).withColumns({"d": 1 + F.col("od") % 40 * 0.9, "g": F.col("od") % 7 * 0.5})
    users = F.array(*[F.struct(F.lit(s).alias("scenario"), F.least("eligible", F.greatest("base", F.col("eligible") * C.propensity(s, F.col("d"), F.col("g")))).alias("n")) for s in C.PROPENSITY])
    each = rows.select("base", F.explode(users).alias("u")).select("base", "u.*")
    return each.groupBy("scenario").agg(F.round(F.sum("n"), 3).alias("users"), F.count("*").alias("ods"), F.round(F.sum("base"), 3).alias("observed"))


@query("""WITH base AS (SELECT o_custkey AS zone, o_orderkey AS od, o_totalprice AS cap, CAST(o_orderkey % 5 AS DOUBLE) AS w0, sum(o_totalprice) OVER (PARTITION BY o_custkey) * 0.4e0 AS t, sum(o_orderkey % 5) OVER (PARTITION BY o_custkey) AS sw FROM orders),
w AS (SELECT *, CASE WHEN sw > 0 THEN w0 ELSE 1e0 END AS w FROM base), r AS (SELECT *, CASE WHEN w > 0 THEN cap ELSE 0e0 END AS room, CASE WHEN w > 0 THEN cap / w ELSE -1e0 END AS o FROM w),
l AS (SELECT *, CASE WHEN w > 0 THEN (t - (sum(room) OVER k - room)) / (sum(w) OVER (PARTITION BY zone) - sum(w) OVER k + w) END AS level FROM r WINDOW k AS (PARTITION BY zone ORDER BY o, cap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT zone, od, round(least(room, greatest(0e0, max(level) OVER (PARTITION BY zone)) * w), 6) AS given FROM l""")
def target_allocation_waterfill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("zone"), F.col("o_orderkey").alias("od"), F.col("o_totalprice").alias("cap"), (F.col("o_orderkey") % 5).cast("double").alias("w"))
    filled = R.water_fill(rows, ["zone"], "w", "cap", F.sum("cap") * 0.4)
    return filled.select("zone", "od", F.round("given", 6).alias("given"))


_CELLS = "cells AS (SELECT c_nationkey AS origin, l_suppkey AS destination, CASE WHEN count(*) < 6 THEN -999 ELSE count(*) END AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), held AS (SELECT *, CASE WHEN n = -999 THEN 0e0 ELSE greatest(0e0, n - 2e0) END AS lower, CASE WHEN n = -999 THEN 2.5e0 ELSE n::DOUBLE END AS point, CASE WHEN n = -999 THEN 5e0 ELSE n + 2e0 END AS upper FROM cells)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.count("*")
    counted = rows.groupBy(F.col("c_nationkey").alias("origin"), F.col("l_suppkey").alias("destination")).agg(F.when(n < 6, F.lit(-999)).otherwise(n).alias("n"))
    return counted.withColumn("i", C.censored_interval(F.col("n"))).select("origin", "destination", "n", "i.*")


@query(f"WITH {_CELLS} SELECT origin, destination, n, lower, point, upper FROM held")
def censored_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query(f"""WITH {_CELLS}, margins AS (SELECT c_nationkey AS origin, count(*)::DOUBLE AS margin FROM customer GROUP BY 1), sums AS (SELECT origin, sum(lower) AS lower, sum(point) AS point, sum(upper) AS upper FROM held GROUP BY 1)
SELECT n_nationkey AS origin, coalesce(lower, 0e0) AS lower, coalesce(point, 0e0) AS point, coalesce(upper, 0e0) AS upper, coalesce(margin, 0e0) AS margin, coalesce(point, 0e0) - coalesce(margin, 0e0) AS residual,
coalesce(lower, 0e0) <= coalesce(margin, 0e0) + 2 AND greatest(0e0, coalesce(margin, 0e0) - 2) <= coalesce(upper, 0e0) AS overlaps FROM nation LEFT JOIN sums ON origin = n_nationkey LEFT JOIN margins m ON m.origin = n_nationkey""")
def margin_comparison(spark: SparkSession, d: str) -> DataFrame:
    sums = _cells(spark, d).groupBy("origin").agg(*(F.sum(c).alias(c) for c in ("lower", "point", "upper")))
    margins = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("origin")).agg(F.count("*").cast("double").alias("margin"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("origin")).join(sums, "origin", "left").join(margins, "origin", "left").fillna(0.0)
    overlaps = (F.col("lower") <= F.col("margin") + 2) & (F.greatest(F.lit(0.0), F.col("margin") - 2) <= F.col("upper"))
    return rows.withColumn("residual", F.col("point") - F.col("margin")).withColumn("overlaps", overlaps)


_POINTS = "a AS (SELECT c_custkey AS a, (c_custkey * 7919 % 10007)::DOUBLE AS ax, (c_custkey * 104729 % 10009)::DOUBLE AS ay FROM customer), b AS (SELECT s_suppkey AS b, (s_suppkey * 7919 % 10007)::DOUBLE AS bx, (s_suppkey * 104729 % 10009)::DOUBLE AS by_ FROM supplier), p AS (SELECT a, b, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS distance FROM a, b)"


def _near(spark: SparkSession, d: str, radius: float) -> DataFrame:
    left = X.points(spark, d, "customer", "c_custkey").toDF("a", "ax", "ay")
    return R.within_radius(left, X.points(spark, d, "supplier", "s_suppkey").toDF("b", "bx", "by"), radius)


def _nearest(spark: SparkSession, d: str, k: int, radius: float) -> DataFrame:
    """Those of _near that may be among the k nearest of their customer."""
    left = X.points(spark, d, "customer", "c_custkey").toDF("a", "ax", "ay")
    return R.nearest(left, X.points(spark, d, "supplier", "s_suppkey").toDF("b", "bx", "by"), k, radius)


@query(f"WITH {_POINTS} SELECT a, b, round(distance, 6) AS distance, round(greatest(0e0, least((250 - distance) / 200, 1e0)), 6) AS credit FROM p WHERE distance <= 1500")
def radius_catchment(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 1500.0).select("a", "b", F.round("distance", 6).alias("distance"), F.round(C.walk_credit(F.col("distance")), 6).alias("credit"))


@query(f"WITH {_POINTS} SELECT a, min_by(b, (distance, b)) AS b, round(min(distance), 6) AS distance FROM p WHERE distance <= 3000 GROUP BY 1")
def nearest_within_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 1, 3000.0).groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"), F.round(F.min("distance"), 6).alias("distance"))


@query("""SELECT CAST(user_id % 97 AS BIGINT) AS cell_x, CAST(floor(value / 5) AS BIGINT) AS cell_y, count(*) AS crashes, count(*) FILTER (event_type = 'error') AS severe FROM events GROUP BY 1, 2 HAVING count(*) >= 3""")
def crash_grid_suppressed(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "events").groupBy((F.col("user_id") % 97).alias("cell_x"), F.floor(F.col("value") / 5).alias("cell_y"))
    return grid.agg(F.count("*").alias("crashes"), F.count_if(F.col("event_type") == "error").alias("severe")).where("crashes >= 3")


@query("""WITH days AS (SELECT user_id AS counter, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT counter, count(*) AS days, round(avg(total), 6) AS daily_mean, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, CASE WHEN count(*) < 3 THEN 'incomplete' ELSE 'kept' END AS reason FROM days GROUP BY 1""")
def counter_daily_mean(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.col("user_id").alias("counter"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return days.groupBy("counter").agg(F.count("*").alias("days"), F.round(F.avg("total"), 6).alias("daily_mean"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"), F.when(F.count("*") < 3, "incomplete").otherwise("kept").alias("reason"))


@query("""WITH m AS (SELECT o_orderpriority AS site, o_totalprice / 1000 AS observed, o_totalprice / 1100 + o_orderkey % 13 AS predicted FROM orders)
SELECT count(*) AS n, round(avg(abs(predicted - observed)), 6) AS mae, round(sqrt(avg((predicted - observed) * (predicted - observed))), 6) AS rmse, round(avg(predicted - observed), 6) AS bias,
round(1 - sum((predicted - observed) * (predicted - observed)) / (var_pop(observed) * count(*)), 6) AS r2, round(corr(observed, predicted), 6) AS pearson, round(regr_slope(observed, predicted), 6) AS slope, round(regr_intercept(observed, predicted), 6) AS intercept FROM m""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("observed"), (F.col("o_totalprice") / 1100 + F.col("o_orderkey") % 13).alias("predicted"))
    found = R.regression_metrics(rows, "observed", "predicted")
    return found.select("n", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@query("""WITH best AS (SELECT p_type, p_retailprice, max(p_size) AS best FROM part GROUP BY 1, 2), run AS (SELECT *, max(best) OVER (PARTITION BY p_type ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)
SELECT p.p_partkey, p.p_type, p.p_size = best AND (before IS NULL OR p.p_size > before) AS efficient FROM part p JOIN run r ON p.p_type = r.p_type AND p.p_retailprice = r.p_retailprice""")
def pareto_cost_benefit(spark: SparkSession, d: str) -> DataFrame:
    return R.pareto(table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice"), "p_retailprice", "p_size", ["p_type"]).select("p_partkey", "p_type", "efficient")


@query(with_("projects", """, s AS (SELECT *, max(users) OVER () AS mu, min(users) OVER () AS nu, max(cost) OVER () AS mc, min(cost) OVER () AS nc FROM projects)
SELECT candidate, round(0.6e0 * (CASE WHEN mu > nu THEN (users - nu) / (mu - nu) ELSE 0.5e0 END) + 0.4e0 * (1 - CASE WHEN mc > nc THEN (cost - nc) / (mc - nc) ELSE 0.5e0 END), 8) AS score FROM s"""))
def preset_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = X.projects(spark, d)
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in ("users", "cost") for n, f in (("low", F.min), ("high", F.max))))
    scaled = lambda c: F.when(F.col(f"high_{c}") > F.col(f"low_{c}"), (F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}"))).otherwise(0.5)
    return rows.crossJoin(F.broadcast(ends)).select("candidate", F.round(0.6 * scaled("users") + 0.4 * (1 - scaled("cost")), 8).alias("score"))  # one row


@query(with_("projects", "SELECT candidate, round(spent, 2) AS spent FROM (SELECT candidate, sum(cost) OVER (ORDER BY users / cost DESC, candidate ROWS UNBOUNDED PRECEDING) AS spent, sum(cost) OVER () * 0.4e0 AS budget FROM projects) WHERE spent <= budget"))
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = X.projects(spark, d)
    spent = R.carried(rows, [F.desc(F.col("users") / F.col("cost")), F.col("candidate")], F.col("cost"), "spent")
    return spent.crossJoin(rows.agg((F.sum("cost") * 0.4).alias("budget"))).where("spent <= budget").select("candidate", F.round("spent", 2).alias("spent"))  # one row


@query(with_("projects", """, y AS (SELECT candidate AS project, r.name AS "case", cost, users, km, rate, year FROM projects CROSS JOIN (VALUES ('low', 0.02e0), ('high', 0.08e0)) r(name, rate) CROSS JOIN (SELECT unnest(range(1, 41)) AS year)),
v AS (SELECT project, "case", cost, sum(least(km * 4.9e0, users * 6200e0) * least(1e0, year / 3e0) * pow(1 + rate, -year)) AS b, sum(cost * (0.0125e0 + CASE WHEN year = 20 THEN 0.125e0 ELSE 0e0 END - CASE WHEN year = 40 THEN 0.05e0 ELSE 0e0 END) * pow(1 + rate, -year)) AS c FROM y GROUP BY 1, 2, 3)
SELECT project, "case", round(b, 2) AS pv_benefit, round(cost + c, 2) AS pv_cost, round(b / (cost + c), 8) AS bcr FROM v"""))
def lifecycle_appraisal(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("low", 0.02), ("high", 0.08)], "case string, rate double")
    found = R.appraisal(X.projects(spark, d).withColumnRenamed("candidate", "project"), rates)
    return found.select("project", "case", F.round("pv_benefit", 2).alias("pv_benefit"), F.round("pv_cost", 2).alias("pv_cost"), F.round("bcr", 8).alias("bcr"))


_DRAWS = "draws AS (SELECT candidate, draw, users * (0.5e0 + (draw * 37 % 100) / 100e0) / (cost * (0.8e0 + ((draw * 53 + length(candidate) + ascii(right(candidate, 1))) % 100) / 250e0)) AS bcr FROM projects CROSS JOIN (SELECT unnest(range(1, 101)) AS draw)), ranked AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY bcr DESC, candidate) AS rank FROM draws)"


@query(with_("projects", f", {_DRAWS} SELECT candidate, round(avg(bcr), 8) AS mean, round(quantile_cont(bcr, 0.05), 8) AS p05, round(quantile_cont(bcr, 0.5), 8) AS p50, round(quantile_cont(bcr, 0.95), 8) AS p95, round(avg(rank), 6) AS mean_rank, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END), 6) AS in_top FROM ranked GROUP BY 1"))
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    draws = X.projects(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(100))))
    benefit = F.col("users") * (0.5 + (F.col("draw") * 37 % 100) / 100.0)
    cost = F.col("cost") * (0.8 + ((F.col("draw") * 53 + F.length("candidate") + F.ascii(F.substring("candidate", -1, 1))) % 100) / 250.0)
    ranked = draws.withColumn("bcr", benefit / cost).withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("bcr"), "candidate")))
    at = lambda p: F.round(F.percentile("bcr", F.lit(p)), 8)
    return ranked.groupBy("candidate").agg(F.round(F.avg("bcr"), 8).alias("mean"), at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg((F.col("rank") <= 5).cast("double")), 6).alias("in_top"))


@query("SELECT l_partkey AS edge, count(DISTINCT l_suppkey) AS projects FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def disjoint_project_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("edge")).agg(F.count_distinct("l_suppkey").alias("projects")).where("projects > 1")


@query(with_("path_edges project_edges ods", "SELECT candidate, count(*) AS ods, round(sum(eligible), 4) AS users FROM (SELECT DISTINCT candidate, od FROM path_edges JOIN project_edges USING (edge)) JOIN ods USING (od) GROUP BY 1"))
def route_users_dedup(spark: SparkSession, d: str) -> DataFrame:
    on = X.path_edges(spark, d).join(X.project_edges(spark, d), "edge").select("candidate", "od").distinct()
    return on.join(X.ods(spark, d), "od").groupBy("candidate").agg(F.count("*").alias("ods"), F.round(F.sum("eligible"), 4).alias("users"))


_ARCS = "arcs AS (SELECT s_nationkey AS u, n_nationkey AS v, 1e0 + (s_suppkey % 9) AS cost FROM supplier JOIN nation ON n_nationkey = (s_nationkey * 3 + s_suppkey) % 25 WHERE s_nationkey <> n_nationkey)"


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    to = ((F.col("s_nationkey") * 3 + F.col("s_suppkey")) % 25).alias("v")
    return table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("u"), to.cast("long").alias("v"), (1.0 + F.col("s_suppkey") % 9).alias("cost")).where("u <> v")


@query(f"WITH RECURSIVE {_ARCS}, both_ AS (SELECT u, v FROM arcs UNION SELECT v, u FROM arcs), reach AS (SELECT u AS a, u AS b FROM both_ UNION SELECT a, v FROM reach JOIN both_ ON b = u) SELECT CAST(a AS BIGINT) AS id, CAST(min(b) AS BIGINT) AS component FROM reach GROUP BY 1")
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_arcs(spark, d).select(F.col("u").alias("a"), F.col("v").alias("b")))


@query(f"WITH RECURSIVE {_ARCS}, reach(source, node, cost, hops) AS (SELECT DISTINCT u, u, 0e0, 0 FROM arcs UNION SELECT source, v, r.cost + a.cost, hops + 1 FROM reach r JOIN arcs a ON node = u WHERE hops < 24 AND r.cost + a.cost <= 12) SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS node, min(cost) AS cost FROM reach GROUP BY 1, 2")
def shortest_path_costs(spark: SparkSession, d: str) -> DataFrame:
    arcs = _arcs(spark, d)
    return G.shortest_costs(arcs, arcs.select(F.col("u").alias("source")).distinct(), limit=12.0)
