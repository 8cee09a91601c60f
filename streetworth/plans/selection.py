"""Queries on choice and selection: diagnostics of candidates, draws, frontiers, budgets, journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.functions import columns as C
from streetworth.operators import relational as R
from streetworth.operators import selection as S
from streetworth.operators.graph import _save
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table, with_
from streetworth.queries import _ACTIVITY, _DRAWS, _PROBABILITY, _SAVINGS, _activity
from streetworth.registry import query


def _draws(spark: SparkSession, d: str) -> DataFrame:
    rows = X.projects(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(100))))
    benefit = F.col("users") * (0.5 + (F.col("draw") * 37 % 100) / 100.0)
    cost = F.col("cost") * (0.8 + ((F.col("draw") * 53 + F.length("candidate") + F.ascii(F.substring("candidate", -1, 1))) % 100) / 250.0)
    ranked = rows.withColumn("bcr", benefit / cost)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("bcr"), "candidate")))


@query(with_("path_edges paths ods project_edges", f""", {_ACTIVITY},
each AS (SELECT candidate, od, e, eligible, expected, after, CASE WHEN after >= expected THEN 0e0 ELSE greatest(0e0, least(eligible * (1 / (1 + exp(-(ln(s / (1 - s)) + e * ln(expected / after)))) - base / eligible), eligible - base)) END AS addition FROM share CROSS JOIN (VALUES (0.5e0), (1e0), (2e0)) v(e)),
top AS (SELECT *, row_number() OVER (PARTITION BY candidate, e ORDER BY addition DESC, od) AS r FROM each)
SELECT candidate, CAST(e AS DOUBLE) AS elasticity, round(sum(addition), 4) AS addition, round(max(addition) / sum(addition), 8) AS largest_share, round(sum(addition) FILTER (r <= 3) / sum(addition), 8) AS top3_share, round(sum(eligible * (expected - after) / expected) / sum(eligible), 10) AS relative_saving FROM top GROUP BY 1, 2"""))
def elasticity_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Additions under three elasticities, and how far they rest on few origin-destination pairs."""
    rows = _activity(spark, d).select("candidate", "od", "expected", "after").join(X.ods(spark, d), "od")
    each = F.array(*[F.struct(F.lit(e).alias("elasticity"), C.odds_response(F.col("eligible"), F.col("base"), F.col("expected"), F.col("after"), e).alias("addition")) for e in (0.5, 1.0, 2.0)])
    rows = rows.select("candidate", "od", "eligible", "expected", "after", F.explode(each).alias("_e")).select("*", "_e.*").drop("_e")
    top = S.top_sum(rows, ["candidate", "elasticity"], "addition", "od", 3)
    total = rows.groupBy("candidate", "elasticity").agg(F.sum("addition").alias("total"), F.max("addition").alias("largest"), (F.sum(F.col("eligible") * (F.col("expected") - F.col("after")) / F.col("expected")) / F.sum("eligible")).alias("saving"))
    out = total.join(top, ["candidate", "elasticity"])
    return out.select("candidate", "elasticity", F.round("total", 4).alias("addition"), F.round(F.col("largest") / F.col("total"), 8).alias("largest_share"), F.round(F.col("top") / F.col("total"), 8).alias("top3_share"), F.round("saving", 10).alias("relative_saving"))


@query(with_("path_edges paths ods project_edges", f""", {_PROBABILITY}, used AS (SELECT DISTINCT candidate, od, path FROM path_edges JOIN project_edges USING (edge)),
shares AS (SELECT candidate, od, least(1e0, sum(probability)) AS share FROM used JOIN probs USING (od, path) GROUP BY 1, 2)
SELECT candidate, round(sum(base * share), 4) AS users_before, round(max(share), 8) AS largest_share, count(*) AS ods FROM shares JOIN ods USING (od) GROUP BY 1"""))
def treatment_usage(spark: SparkSession, d: str) -> DataFrame:
    """Users whose chosen paths already meet each candidate's edges."""
    edges = X.path_edges(spark, d)
    used = edges.join(X.project_edges(spark, d), "edge").select("candidate", "od", "path").distinct()
    chosen = R.path_probabilities(X.paths(edges), X.THETA).select("od", "path", "probability")
    shares = used.join(chosen, ["od", "path"]).groupBy("candidate", "od").agg(F.least(F.lit(1.0), F.sum("probability")).alias("share"))
    return shares.join(X.ods(spark, d), "od").groupBy("candidate").agg(F.round(F.sum(F.col("base") * F.col("share")), 4).alias("users_before"), F.round(F.max("share"), 8).alias("largest_share"), F.count("*").alias("ods"))


@query(with_("projects", f""", {_DRAWS}, base AS (SELECT candidate, row_number() OVER (ORDER BY users / cost DESC, candidate) AS first FROM projects),
both_ AS (SELECT draw, count(*) FILTER (rank <= 5 AND first <= 5) AS n FROM ranked JOIN base USING (candidate) GROUP BY 1),
pairs AS (SELECT a.draw, sum(CASE WHEN (a.rank < b.rank) = (a.first < b.first) THEN 1e0 ELSE -1e0 END) / count(*) AS tau FROM (SELECT * FROM ranked JOIN base USING (candidate)) a JOIN (SELECT * FROM ranked JOIN base USING (candidate)) b ON a.draw = b.draw AND a.candidate < b.candidate GROUP BY 1)
SELECT draw, round(n / (10e0 - n), 8) AS jaccard, round(tau, 8) AS kendall_tau FROM both_ JOIN pairs USING (draw)"""))
def draw_agreement(spark: SparkSession, d: str) -> DataFrame:
    """For each draw, overlap of the first five with the central case's, and Kendall's tau over all candidates."""
    central = R.carried(X.projects(spark, d), [F.desc(F.col("users") / F.col("cost")), F.col("candidate")], F.lit(1), "first").select("candidate", "first")
    ranked = _draws(spark, d).select("draw", "candidate", "rank").join(central, "candidate")
    return S.agreement(ranked, "draw", "candidate", "rank", "first", 5).select(F.col("draw").cast("long").alias("draw"), F.round("jaccard", 8).alias("jaccard"), F.round("tau", 8).alias("kendall_tau"))


@query(with_("projects", f""", {_DRAWS}, spent AS (SELECT *, users * (0.5e0 + (draw * 37 % 100) / 100e0) AS benefit, cost * (0.8e0 + ((draw * 53 + length(candidate) + ascii(right(candidate, 1))) % 100) / 250e0) AS paid FROM draws JOIN projects USING (candidate)),
best AS (SELECT draw, paid, max(benefit) AS best FROM spent GROUP BY 1, 2), run AS (SELECT *, max(best) OVER (PARTITION BY draw ORDER BY paid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)
SELECT candidate, round(avg(CASE WHEN benefit = best AND (before IS NULL OR benefit > before) THEN 1e0 ELSE 0e0 END), 8) AS membership FROM spent JOIN run USING (draw, paid) GROUP BY 1"""))
def frontier_stability(spark: SparkSession, d: str) -> DataFrame:
    """Share of draws in which each candidate is on the cost-benefit frontier."""
    rows = _draws(spark, d).withColumn("benefit", F.col("users") * (0.5 + (F.col("draw") * 37 % 100) / 100.0))
    rows = rows.withColumn("paid", F.col("cost") * (0.8 + ((F.col("draw") * 53 + F.length("candidate") + F.ascii(F.substring("candidate", -1, 1))) % 100) / 250.0))
    on = R.pareto(rows.select("draw", "candidate", "benefit", "paid"), "paid", "benefit", ["draw"])
    return on.groupBy("candidate").agg(F.round(F.avg(F.col("efficient").cast("double")), 8).alias("membership"))


@query(with_("projects", "SELECT a.candidate, NOT EXISTS (SELECT 1 FROM projects b WHERE b.users >= a.users AND b.km >= a.km AND b.cost <= a.cost AND (b.users > a.users OR b.km > a.km OR b.cost < a.cost)) AS efficient FROM projects a"))
def pareto_many_objectives(spark: SparkSession, d: str) -> DataFrame:
    return S.pareto_many(X.projects(spark, d), "candidate", more=["users", "km"], less=["cost"]).select("candidate", "efficient")


_RATES = "years AS (SELECT year, exp(sum(ln(1 + CASE WHEN year <= 30 THEN 0.02e0 WHEN year <= 100 THEN 0.015e0 ELSE 0.01e0 END)) OVER (ORDER BY year)) AS growth FROM (SELECT unnest(range(1, 121)) AS year))"


@query(with_("projects", f", {_RATES} SELECT candidate, round(sum(least(km * 4.9e0, users * 6200e0) * least(1e0, year / 3e0) / growth), 2) AS pv_benefit, round(cost + sum(cost * 0.0125e0 / growth), 2) AS pv_cost FROM projects CROSS JOIN years GROUP BY candidate, cost"))
def declining_rate_appraisal(spark: SparkSession, d: str) -> DataFrame:
    """120 years under a rate of 2 %, then 1.5 % after year 30 and 1 % after year 100."""
    rows = X.projects(spark, d).withColumn("y", F.explode(S.discount_schedule(120, [(30, 0.02), (100, 0.015), (120, 0.01)]))).select("*", "y.*")
    benefit = F.least(F.col("km") * 4.9, F.col("users") * 6200.0) * F.least(F.lit(1.0), F.col("year") / 3)
    return rows.groupBy("candidate", "cost").agg(F.round(F.sum(benefit / F.col("growth")), 2).alias("pv_benefit"), F.round(F.col("cost") + F.sum(F.col("cost") * 0.0125 / F.col("growth")), 2).alias("pv_cost")).drop("cost")


_GAINS = "cells AS (SELECT o_orderkey AS od, c_nationkey AS cell FROM orders JOIN customer ON o_custkey = c_custkey), gains AS (SELECT candidate, cell, sum(addition) AS gain FROM added JOIN cells USING (od) GROUP BY 1, 2)"


def _gains(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("od"), F.col("c_nationkey").alias("cell"))
    return _activity(spark, d).join(cells, "od").groupBy("candidate", "cell").agg(F.sum("addition").alias("gain"))


@query(with_("path_edges paths ods project_edges", f""", {_ACTIVITY}, {_GAINS}, shares AS (SELECT *, gain / sum(gain) OVER (PARTITION BY candidate) AS share, row_number() OVER (PARTITION BY candidate ORDER BY gain DESC, cell) AS r FROM gains)
SELECT candidate, round(sum(gain), 4) AS total, count(*) FILTER (gain > 0) AS positive, round(max(share), 8) AS largest_share, round(sum(share) FILTER (r <= 3), 8) AS top3_share, round(1 / sum(share * share), 6) AS effective_n, min(cell) FILTER (r = 1) AS driver FROM shares GROUP BY 1"""))
def source_concentration(spark: SparkSession, d: str) -> DataFrame:
    """How far each candidate's additions rest on few source cells, and the cell that gives most."""
    gains = _gains(spark, d)
    top = S.top_sum(gains, ["candidate"], "gain", "cell", 3)
    sums = gains.groupBy("candidate").agg(F.sum("gain").alias("total"), F.count_if(F.col("gain") > 0).alias("positive"), F.max("gain").alias("most"), F.sum(F.col("gain") * F.col("gain")).alias("squares"), F.min_by("cell", F.struct((-F.col("gain")).alias("g"), "cell")).alias("driver"))
    out = sums.join(top, "candidate")
    return out.select("candidate", F.round("total", 4).alias("total"), "positive", F.round(F.col("most") / F.col("total"), 8).alias("largest_share"), F.round(F.col("top") / F.col("total"), 8).alias("top3_share"), F.round(F.col("total") * F.col("total") / F.col("squares"), 6).alias("effective_n"), "driver")


@query(with_("path_edges paths ods project_edges", f""", {_ACTIVITY}, {_GAINS}, totals AS (SELECT candidate, sum(gain) AS total FROM gains GROUP BY 1),
left_ AS (SELECT k.cell AS gone, candidate, total - coalesce(gain, 0e0) AS rest FROM totals CROSS JOIN (SELECT DISTINCT cell FROM gains) k LEFT JOIN gains g USING (candidate, cell)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gone ORDER BY round(rest, 6) DESC, candidate) AS rank FROM left_)
SELECT candidate, min(rank) AS best_rank, max(rank) AS worst_rank, round(min(rest), 4) AS least_total FROM ranked GROUP BY 1"""))
def source_cell_influence(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the candidates as each source cell is left out in turn. The gains are saved, as all that follows reads them, and they take the whole ledger."""
    gains = _save(_gains(spark, d))
    totals = gains.groupBy("candidate").agg(F.sum("gain").alias("total"))
    cases = gains.select("cell").distinct().crossJoin(totals).join(gains, ["candidate", "cell"], "left")  # a row for each case and candidate is the result
    rest = cases.withColumn("rest", F.col("total") - F.coalesce("gain", F.lit(0.0)))
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc(F.round("rest", 6)), "candidate")))
    return ranked.groupBy("candidate").agg(F.min("rank").cast("long").alias("best_rank"), F.max("rank").cast("long").alias("worst_rank"), F.round(F.min("rest"), 4).alias("least_total"))


@query(with_("path_edges project_edges", """, need AS (SELECT od, path, count(DISTINCT candidate) AS projects, count(DISTINCT CASE WHEN right(candidate, 1) NOT IN ('1', '2') THEN candidate END) AS missing FROM path_edges LEFT JOIN project_edges USING (edge) GROUP BY 1, 2)
SELECT od, CASE WHEN min(projects) = 0 THEN 'already' WHEN min(missing) = 0 THEN 'package' ELSE 'needs' END AS status, min(missing) AS missing FROM need GROUP BY 1"""))
def journey_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether the funded package serves each journey: by its path that lacks the fewest projects."""
    rows = X.path_edges(spark, d).join(X.project_edges(spark, d), "edge", "left")
    unfunded = F.when(~F.substring("candidate", -1, 1).isin("1", "2"), F.col("candidate"))
    need = rows.groupBy("od", "path").agg(F.count_distinct("candidate").alias("projects"), F.count_distinct(unfunded).alias("missing"))
    return need.groupBy("od").agg(F.when(F.min("projects") == 0, "already").when(F.min("missing") == 0, "package").otherwise("needs").alias("status"), F.min("missing").alias("missing"))


@query("""WITH u AS (SELECT p AS parameter, i AS draw, (row_number() OVER (PARTITION BY p ORDER BY sha256('7|' || p || '|' || i), i) - 1 + CAST('0x' || substr(sha256('u|7|' || p || '|' || i), 1, 8) AS BIGINT) / 4294967296e0) / 200 AS u FROM (VALUES ('demand'), ('cost'), ('value')) v(p) CROSS JOIN (SELECT unnest(range(200)) AS i))
SELECT parameter, CAST(draw AS BIGINT) AS draw, round(CASE parameter WHEN 'demand' THEN 0.5e0 + u WHEN 'cost' THEN exp(ln(0.8e0) + u * (ln(1.6e0) - ln(0.8e0))) ELSE CASE WHEN u < 0.25e0 THEN 2 + sqrt(u * 8 * 2) ELSE 10 - sqrt((1 - u) * 8 * 6) END END, 9) AS value FROM u""")
def latin_hypercube(spark: SparkSession, d: str) -> DataFrame:
    """200 draws of a uniform, a log-uniform and a triangular parameter, one in each 200th of its range."""
    drawn = S.latin_hypercube(spark, ["demand", "cost", "value"], 200, 7)
    u, p = F.col("u"), F.col("parameter")
    value = F.when(p == "demand", C.inverse_uniform(u, 0.5, 1.5)).when(p == "cost", C.inverse_loguniform(u, 0.8, 1.6)).otherwise(C.inverse_triangular(u, 2.0, 4.0, 10.0))
    return drawn.select("parameter", "draw", F.round(value, 9).alias("value"))


_ADDED = "CASE WHEN {after} >= expected THEN 0e0 ELSE greatest(0e0, least(eligible * (1 / (1 + exp(-(ln(s / (1 - s)) + 0.6e0 * ln(expected / ({after}))))) - base / eligible), eligible - base)) END"


def _build_sql(steps: int) -> str:
    """A build order written out step by step; steps that find nothing more to build are empty."""
    parts = [f"{_PROBABILITY}, {_SAVINGS}", "saved AS MATERIALIZED (SELECT * FROM savings WHERE saving > 0)", "w0 AS MATERIALIZED (SELECT od, path, probability AS p, probability AS weight FROM probs)", "c AS (SELECT od, sum(probability * cost) AS expected FROM probs GROUP BY 1)",
             "pair AS MATERIALIZED (SELECT od, expected, eligible, base, greatest(1e-5, least(base / eligible, 1 - 1e-5)) AS s FROM c JOIN ods USING (od))", "st0 AS MATERIALIZED (SELECT *, 1e0 AS mass, 0e0 AS added FROM pair)", "built0 AS (SELECT '' AS candidate, 0e0 AS cost)"]
    for i in range(1, steps + 1):
        j = i - 1
        parts.append(f"g{i} AS (SELECT candidate, od, sum(weight * (exp(0.05e0 * saving) - 1)) AS more FROM saved JOIN w{j} USING (od, path) WHERE candidate NOT IN (SELECT candidate FROM built{j}) GROUP BY 1, 2)")
        parts.append(f"v{i} AS (SELECT candidate, sum({_ADDED.format(after='expected - ln(mass + more) / 0.05e0')} - added) AS marginal FROM g{i} JOIN st{j} USING (od) GROUP BY 1)")
        parts.append(f"b{i} AS MATERIALIZED (SELECT {i} AS step, candidate, cost, marginal FROM v{i} JOIN projects USING (candidate) WHERE cost <= (SELECT sum(cost) / 3 FROM projects) - (SELECT sum(cost) FROM built{j}) AND marginal > 1e-12 ORDER BY marginal / cost DESC, marginal DESC, cost, candidate DESC LIMIT 1)")
        parts.append(f"built{i} AS MATERIALIZED (SELECT * FROM built{j} UNION ALL SELECT candidate, cost FROM b{i}), w{i} AS MATERIALIZED (SELECT od, path, p, weight * exp(0.05e0 * coalesce(saving, 0e0)) AS weight FROM w{j} LEFT JOIN (SELECT od, path, saving FROM saved JOIN b{i} USING (candidate)) USING (od, path))")
        parts.append(f"st{i} AS MATERIALIZED (SELECT p.*, mass, {_ADDED.format(after='expected - ln(mass) / 0.05e0')} AS added FROM pair p JOIN (SELECT od, 1 + sum(weight - p) AS mass FROM w{i} GROUP BY 1) USING (od))")
    rows = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, steps + 1))
    return f", {', '.join(parts)} SELECT CAST(step AS INTEGER) AS step, candidate, round(cost, 2) AS cost, round(marginal, 4) AS marginal, round(sum(marginal) OVER (ORDER BY step), 4) AS total FROM ({rows})"


@query(with_("path_edges paths ods project_edges projects", _build_sql(12)))
def greedy_build_order(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative build order within a third of all costs, every step valued again on what is built."""
    edges = X.path_edges(spark, d)
    paths = R.path_probabilities(X.paths(edges), X.THETA)
    savings = R.path_savings(edges, X.project_edges(spark, d))
    steps = S.greedy_sequence(savings, paths, X.ods(spark, d), X.projects(spark, d), X.THETA, X.ELASTICITY, share=1 / 3)
    return steps.select("step", "candidate", F.round("cost", 2).alias("cost"), F.round("marginal", 4).alias("marginal"), F.round("total", 4).alias("total"))
