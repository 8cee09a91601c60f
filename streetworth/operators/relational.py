"""Operators as compositions of joins, aggregations and windows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetworth.functions.columns import odds_response
from streetworth.operators.graph import _save


def path_savings(path_edges: DataFrame, edge_candidates: DataFrame) -> DataFrame:
    """Saving of each path by each candidate: path_edges(od, path, edge, cost) and edge_candidates(edge, candidate, keep), keep being the share of cost that stays.

    Spark adds up partly before the shuffle; the candidates' edges are broadcast only if their size allows.
    """
    return path_edges.join(edge_candidates, "edge").groupBy("od", "path", "candidate").agg(F.sum(F.col("cost") * (1 - F.col("keep"))).alias("saving"))


def path_probabilities(paths: DataFrame, theta: float, utility: Column | None = None) -> DataFrame:
    """paths(od, path, cost) with probability, a softmax of -theta * cost (or of `utility`) within each od, shifted by its maximum."""
    own = Window.partitionBy("od")
    u = (-theta * F.col("cost")) if utility is None else utility
    weighed = paths.withColumn("_u", u).withColumn("_e", F.exp(F.col("_u") - F.max("_u").over(own)))
    return weighed.withColumn("probability", F.col("_e") / F.sum("_e").over(own)).drop("_u", "_e")


def single_candidate_activity(savings: DataFrame, paths: DataFrame, ods: DataFrame, theta: float, elasticity: float) -> DataFrame:
    """Each candidate alone: per (candidate, od) the log-sum saving over the od's paths and the additional users.

    paths(od, path, cost, probability), ods(od, eligible, base). Paths without a saving need no row: the sum of p * exp(theta * saving) over all paths is
    1 + the sum of p * (exp(theta * saving) - 1) over the others, so nothing is crossed with all candidates.
    """
    touched = savings.join(paths, ["od", "path"])
    grouped = touched.groupBy("candidate", "od").agg(F.sum(F.col("probability") * (F.exp(theta * F.col("saving")) - 1)).alias("more"))
    expected = paths.groupBy("od").agg(F.sum(F.col("probability") * F.col("cost")).alias("expected"))
    joined = grouped.join(expected, "od").join(ods, "od").withColumn("after", F.col("expected") - F.log1p("more") / theta)
    added = odds_response(F.col("eligible"), F.col("base"), F.col("expected"), F.col("after"), elasticity)
    return joined.select("candidate", "od", "expected", "after", added.alias("addition"), (F.col("eligible") * (F.col("expected") - F.col("after")) / F.col("expected")).alias("improvement"))


def carried(rows: DataFrame, order: list[Column], value: Column, name: str, how=F.sum, before: bool = False, by: list[str] | None = None) -> DataFrame:
    """rows with a running aggregate in an order over all of them, or over each group of `by`: `how` of `value` up to the row, or up to the row before it.

    Range partitions of (group, order) are saved, each is aggregated by group, and what the partitions before give is carried into each, so that neither all rows nor a hot group meet in one
    task; only one number for a partition and group is summed in a window.
    """
    by = by or []
    groups = [F.col(c) for c in by]
    parts = _save(rows.withColumn("_c_value", value).repartitionByRange(*groups, *order).withColumn("_c_part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "_c_part").agg(how("_c_value").alias("_c_sum"))
    sums = sums.withColumn("_c_before", how("_c_sum").over(Window.partitionBy(*by).orderBy("_c_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_c_sum")
    run = how("_c_value").over(Window.partitionBy("_c_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow))
    both = F.array(F.col("_c_run"), F.col("_c_before"))
    total = F.when(F.col("_c_run").isNull() | F.col("_c_before").isNull(), F.coalesce("_c_run", "_c_before")).otherwise(F.array_max(both) if how is F.max else F.col("_c_run") + F.col("_c_before"))
    ran = parts.withColumn("_c_run", run)
    if by:
        own = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by]
        joined = ran.join(sums.select(F.col("_c_part").alias("_c_p"), *(F.col(c).alias(f"_c_{c}") for c in by), "_c_before"), [F.col("_c_part") == F.col("_c_p"), *own], "left").drop("_c_p", *(f"_c_{c}" for c in by))
    else:
        joined = ran.join(F.broadcast(sums), "_c_part")  # a line a partition
    return joined.withColumn(name, total).drop("_c_value", "_c_part", "_c_run", "_c_before")


def pareto(rows: DataFrame, cost: str, benefit: str, by: list[str] | None = None) -> DataFrame:
    """rows with `efficient`: the best benefit of its cost, and better than every cheaper row's. Rows of equal cost and benefit are all kept.

    First one row for each cost, then a running maximum over the costs, so that the ordered window sees distinct costs only. The rows are saved first: costs and benefits that are sums would
    come out of a second run with other last places, and then neither meet nor equal themselves.
    """
    by, rows = by or [], _save(rows)
    best = rows.groupBy(*by, cost).agg(F.max(benefit).alias("_best"))
    if by:
        best = best.withColumn("_before", F.max("_best").over(Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        best = carried(best, [F.col(cost)], F.col("_best"), "_before", F.max, before=True)
    joined = rows.join(best, [*by, cost])
    return joined.withColumn("efficient", (F.col(benefit) == F.col("_best")) & (F.col("_before").isNull() | (F.col(benefit) > F.col("_before")))).drop("_best", "_before")


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """The `size` rows of each stratum that come first by hash, with inclusion probability and Horvitz-Thompson weight."""
    own = Window.partitionBy(stratum)
    place = F.sha2(F.concat_ws("|", F.lit(seed), F.col(stratum).cast("string"), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("rank", F.row_number().over(own.orderBy(place, key))).withColumn("stratum_size", F.count("*").over(own))
    chosen = ranked.where(F.col("rank") <= size)
    return chosen.withColumn("inclusion", F.least(F.lit(1.0), F.lit(float(size)) / F.col("stratum_size"))).withColumn("weight", 1 / F.col("inclusion"))


def water_fill(rows: DataFrame, by: list[str], weight: str, cap: str, target: Column) -> DataFrame:
    """Share min(target, all caps) of each group by weight, no row above its cap: `given` = min(cap, level * weight). `target` is an aggregate of the group's rows.

    The level is found in closed form from running sums in the order of cap / weight, carried over range partitions, so a hot group is spread over tasks. Where all weights of a group are 0,
    they count as equal.
    """
    totals = rows.groupBy(*by).agg(F.sum(weight).alias("_all"), target.alias("_t"))
    rows = with_sums(rows, totals, by)
    w = F.when(F.col("_all") > 0, F.col(weight)).otherwise(F.lit(1.0))
    rows = rows.withColumn("_w", w).withColumn("_room", F.when(F.col("_w") > 0, F.col(cap)).otherwise(0.0)).withColumn("_ratio", F.when(F.col("_w") > 0, F.col(cap) / F.col("_w")).otherwise(-1.0)).drop("_all")
    order = [F.col("_ratio"), F.col(cap)]
    rows = carried(carried(rows, order, F.col("_room"), "_before", by=by), order, F.col("_w"), "_w_before", by=by)
    whole = rows.groupBy(*by).agg(F.sum("_w").alias("_w_all"))
    rows = with_sums(rows, whole, by)
    level = F.when(F.col("_w") > 0, (F.col("_t") - (F.col("_before") - F.col("_room"))) / (F.col("_w_all") - F.col("_w_before") + F.col("_w")))
    rows = _save(rows.withColumn("_level", level))
    rows = with_sums(rows, rows.groupBy(*by).agg(F.max("_level").alias("_top")), by)
    return rows.withColumn("given", F.least("_room", F.greatest(F.lit(0.0), F.col("_top")) * F.col("_w"))).drop("_w", "_t", "_room", "_ratio", "_before", "_w_before", "_w_all", "_level", "_top")


def with_sums(rows: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """rows with their group's sums; null keys meet, and without keys there is one row of sums."""
    if not by:
        return rows.crossJoin(F.broadcast(sums))
    other = sums.select(*(F.col(c).alias(f"_on_{c}") for c in by), *(c for c in sums.columns if c not in by))
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in by]).drop(*(f"_on_{c}" for c in by))


def path_size(path_edges: DataFrame) -> DataFrame:
    """Path-size factor of each path: the sum over its edges of length / path length / number of the od's paths on the edge, held in (1e-12, 1]."""
    on_edge = path_edges.withColumn("_n", F.count("*").over(Window.partitionBy("od", "edge")))
    sums = on_edge.groupBy("od", "path").agg(F.sum("cost").alias("cost"), F.sum(F.col("cost") / F.col("_n")).alias("_s"))
    return sums.withColumn("path_size", F.greatest(F.lit(1e-12), F.least(F.col("_s") / F.col("cost"), F.lit(1.0)))).drop("_s")


def within_radius(left: DataFrame, right: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of left(a, ax, ay) and right(b, bx, by) at most `radius` apart: an equi-join on grid cells of that size, the right side in its nine cells, then the exact distance. Pairs also agree in
    the columns of `by`."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.sequence(cell("bx") - 1, cell("bx") + 1)).alias("_cx")
    right = right.select("*", near).select("*", F.explode(F.sequence(cell("by") - 1, cell("by") + 1)).alias("_cy"))
    left = left.withColumns({"_cx": cell("ax"), "_cy": cell("ay")})
    distance = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return left.join(right, ["_cx", "_cy", *(by or [])]).withColumn("distance", distance).where(F.col("distance") <= radius).drop("_cx", "_cy")


def nearest_pairs(points: DataFrame, pairs: Callable[[DataFrame, float], DataFrame], keys: list[str], k: int, first: float, radius: float) -> DataFrame:
    """Pairs at most `radius` apart among which are the k nearest of each row of `points`, with all that are as near as the last of these, or nearer: `pairs(points, r)` gives all pairs with `distance` <= r.

    The reach doubles from `first`, round by round, and a row that has k pairs within it goes no further, so what a row meets depends on k, not on how many lie within the radius. Distances that
    are equal after rounding to six places count as equal.
    """
    found, r = None, first
    while r < radius:
        met = _save(pairs(points, r))
        done = met.where(F.col("distance") <= r - 2e-6).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select(*keys)
        near = met.join(done, keys, "left_semi")
        found = near if found is None else found.unionByName(near)
        points = _save(points.join(done, keys, "left_anti"))
        if points.isEmpty():
            return found
        r *= 2
    rest = pairs(points, radius)
    return rest if found is None else found.unionByName(rest)


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float, by: list[str] | None = None) -> DataFrame:
    """Those pairs of within_radius(left, right, radius, by) that may be among the k nearest of a (in its `by`), see nearest_pairs. The first reach is where about 4 k of the right side are to be expected."""
    by = by or []
    s = right.agg(F.count("*").alias("n"), F.max("bx").alias("x1"), F.min("bx").alias("x0"), F.max("by").alias("y1"), F.min("by").alias("y0"), F.count_distinct(*by).alias("kinds") if by else F.lit(1).alias("kinds")).first()
    first = math.sqrt(4 * k * max(s.kinds, 1) * (s.x1 - s.x0) * (s.y1 - s.y0) / (math.pi * s.n)) if s.n else radius
    return nearest_pairs(left, lambda p, r: within_radius(p, right, r, by), ["a", *by], k, max(first, radius / 1024) if 2 * first < radius else radius, radius)


def regression_metrics(rows: DataFrame, observed: str, predicted: str) -> DataFrame:
    """n, mean absolute and root mean square error, bias, predictive R2, correlation, calibration of observed on predicted, in one pass."""
    e = F.col(predicted) - F.col(observed)
    n, sst = F.count("*"), F.var_pop(observed) * F.count("*")
    return rows.agg(n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"), F.corr(observed, predicted).alias("pearson"), F.regr_slope(observed, predicted).alias("slope"), F.regr_intercept(observed, predicted).alias("intercept"))


def appraisal(projects: DataFrame, rates: DataFrame, years: int = 40, health_per_km: float = 4.90, health_cap: float = 6200.0, ramp_years: int = 3) -> DataFrame:
    """Lifecycle appraisal of projects(project, cost, users, km) under rates(case, rate): discounted benefits and costs, net present value and their ratio.

    Benefits ramp up over ramp_years; maintenance is 1.25 % a year, renewal 12.5 % in year 20, and 5 % of the cost is left at the end.
    """
    year = projects.crossJoin(rates).withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    benefit = F.least(F.col("km") * health_per_km, F.col("users") * health_cap) * F.least(F.lit(1.0), F.col("year") / ramp_years)
    spent = F.col("cost") * (0.0125 + F.when(F.col("year") == 20, 0.125).otherwise(0.0) - F.when(F.col("year") == years, 0.05).otherwise(0.0))
    factor = F.pow(1 + F.col("rate"), -F.col("year").cast("double"))
    sums = year.groupBy("project", "case", "cost").agg(F.sum(benefit * factor).alias("pv_benefit"), F.sum(spent * factor).alias("_later"))
    sums = sums.withColumn("pv_cost", F.col("cost") + F.col("_later")).drop("_later")
    return sums.withColumn("npv", F.col("pv_benefit") - F.col("pv_cost")).withColumn("bcr", F.col("pv_benefit") / F.col("pv_cost"))
