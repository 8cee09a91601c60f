"""Queries behind views and reports: ranked lists, sets, counts, conversions, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.operators import relational as R
from streetworth.operators.graph import _save
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table, with_
from streetworth.queries import _ACTIVITY, _STRESS, _activity, _levels
from streetworth.registry import query


@query("SELECT * FROM (SELECT l_partkey AS edge, round(sum(l_quantity), 4) AS flow FROM lineitem GROUP BY 1 ORDER BY flow DESC, edge LIMIT 12)")
def busiest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The twelve edges of most flow, ties to the smaller id; the limit is the report's."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("edge")).agg(F.round(F.sum("l_quantity"), 4).alias("flow")).orderBy(F.desc("flow"), "edge").limit(12)


@query("SELECT row_number() OVER (ORDER BY scenario, candidate, purpose) AS line, * FROM (SELECT l_linestatus AS scenario, p_brand AS candidate, l_returnflag AS purpose, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)")
def canonical_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger in its canonical order with line numbers, counted over range partitions."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_linestatus").alias("scenario"), F.col("p_brand").alias("candidate"), F.col("l_returnflag").alias("purpose")).agg(F.count("*").alias("n"))
    return R.carried(rows, [F.col("scenario"), F.col("candidate"), F.col("purpose")], F.lit(1), "line").select(F.col("line").cast("long").alias("line"), "scenario", "candidate", "purpose", "n")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE contains(lower(CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority || ' ' || o_orderstatus), 'urgent') ORDER BY o_orderkey LIMIT 40 OFFSET 80")
def listed_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 40 of a list, filtered by a text over id, name and status; the page is the feature."""
    text = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus"))
    return table(spark, d, "orders").where(text.contains("urgent")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).orderBy("id").offset(80).limit(40)


@query("""WITH s AS (SELECT o_orderstatus AS budget, o_orderpriority AS method, o_custkey % 50 AS selected, sum(o_totalprice) AS cost, count(*) AS weight FROM orders GROUP BY 1, 2, 3) SELECT budget, method, selected, weight, round(cost, 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY weight DESC, cost, selected, method) AS n FROM s) WHERE n = 1""")
def preferred_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Of each budget's solutions the one of most weight, then of least cost, fewest projects and the first method."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("budget"), F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 50).alias("selected")).agg(F.sum("o_totalprice").alias("cost"), F.count("*").alias("weight"))
    best = rows.groupBy("budget").agg(F.min(F.struct((-F.col("weight")).alias("w"), "cost", "selected", "method", "weight")).alias("b"))
    return best.select("budget", "b.method", "b.selected", "b.weight", F.round("b.cost", 4).alias("cost"))


@query(with_("path_edges", """, r AS (SELECT od, path, list(edge ORDER BY edge) AS arcs, 1 AS source FROM path_edges GROUP BY 1, 2 UNION ALL SELECT od, path + 100, list(edge ORDER BY edge), 2 FROM path_edges WHERE cost < 40 GROUP BY 1, 2)
SELECT od, path, source, len(arcs) AS arcs FROM (SELECT *, row_number() OVER (PARTITION BY od, arcs ORDER BY source, path) AS n FROM r) WHERE n = 1"""))
def route_union(spark: SparkSession, d: str) -> DataFrame:
    """Routes of two searches together; of equal sequences of arcs the earlier search's stays."""
    edges = X.path_edges(spark, d)
    listed = lambda t, shift, n: t.groupBy("od", "path").agg(F.sort_array(F.collect_list("edge")).alias("arcs")).select("od", (F.col("path") + shift).alias("path"), "arcs", F.lit(n).alias("source"))
    both = listed(edges, 0, 1).unionByName(listed(edges.where("cost < 40"), 100, 2))
    return both.groupBy("od", "arcs").agg(F.min(F.struct("source", "path")).alias("m")).select("od", "m.path", "m.source", F.size("arcs").cast("long").alias("arcs"))


@query("SELECT status, reason, count(*) AS ods FROM (SELECT CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'F' THEN 'assigned' ELSE 'capped' END AS status, CASE o_orderstatus WHEN 'P' THEN o_orderpriority WHEN 'O' THEN 'label_limit' END AS reason FROM orders) GROUP BY 1, 2")
def stop_reasons(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.when(s == "P", "failed").when(s == "F", "assigned").otherwise("capped").alias("status"), F.when(s == "P", F.col("o_orderpriority")).when(s == "O", "label_limit").alias("reason")).agg(F.count("*").alias("ods"))


@query("""SELECT c_nationkey AS area, count(*) AS journeys, count(*) FILTER (o_orderstatus = 'F') AS connected, count(*) FILTER (o_orderstatus = 'O') AS capped, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS urgent_gaps, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 3) AS served FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def pilot_summary(spark: SparkSession, d: str) -> DataFrame:
    """Journeys of each area by what became of them."""
    s = F.col("o_orderstatus")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("journeys"), F.count_if(s == "F").alias("connected"), F.count_if(s == "O").alias("capped"), F.count_if((F.col("o_orderpriority") == "1-URGENT") & (s != "F")).alias("urgent_gaps"), F.round(F.sum(F.when(s == "F", F.col("o_totalprice"))), 3).alias("served"))


@query("SELECT p_type AS \"group\", count(*) AS links, round(sum(p_retailprice * 1.5e0), 3) AS cost, round(sum(p_size * 0.1e0), 6) AS km FROM part GROUP BY 1")
def group_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("group")).agg(F.count("*").alias("links"), F.round(F.sum(F.col("p_retailprice") * 1.5), 3).alias("cost"), F.round(F.sum(F.col("p_size") * 0.1), 6).alias("km"))


@query("""WITH c AS (SELECT c_custkey AS cell, greatest(0e0, c_acctbal) AS v FROM customer), o AS (SELECT v, row_number() OVER (ORDER BY v, cell) AS i, count(*) OVER () AS n FROM c WHERE v > 0) SELECT q AS share, round(max(v) FILTER (i - 1 = CAST(floor(q * (n - 1)) AS BIGINT)), 4) AS break FROM o, (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0)) s(q) GROUP BY 1""")
def map_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Breaks of a map's classes: of the positive values in order, those at index floor(q * (n - 1))."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("v")).where("v > 0")
    placed = R.carried(rows, [F.col("v"), F.col("cell")], F.lit(1), "i").crossJoin(rows.agg(F.count("*").alias("n")))  # one row
    each = placed.withColumn("share", F.explode(F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8))))).where(F.col("i") - 1 == F.floor(F.col("share") * (F.col("n") - 1)))
    return each.select("share", F.round("v", 4).alias("break"))


@query("""SELECT c_custkey AS cell, period, round(greatest(0e0, c_acctbal) * CASE period WHEN 'day' THEN 2e0 WHEN 'month' THEN 220 * 2 / 12e0 ELSE 220 * 2e0 END, 6) AS journeys FROM customer CROSS JOIN (VALUES ('year'), ('month'), ('day')) v(period)""")
def journeys_by_period(spark: SparkSession, d: str) -> DataFrame:
    """People turned into journeys a year, an average month and a day of commuting: 220 days, two ways."""
    people = F.greatest(F.lit(0.0), F.col("c_acctbal"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.lit(f).alias("f")) for p, f in (("year", 440.0), ("month", 440 / 12), ("day", 2.0))]))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), people.alias("people"), each.alias("e")).select("cell", "e.period", F.round(F.col("people") * F.col("e.f"), 6).alias("journeys"))


@query(with_("projects", " SELECT candidate, round(cost * 1.2e0, 4) AS cost, round(4.9e0 * 1.2e0, 6) AS health_per_km, round(6200 * 1.2e0, 4) AS health_cap, round(users, 4) AS users, round(km, 4) AS km FROM projects"))
def rebased_prices(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of an appraisal in the prices of another year: money is multiplied, people and distances are not."""
    money = F.lit(1.2)
    return X.projects(spark, d).select("candidate", F.round(F.col("cost") * money, 4).alias("cost"), F.round(4.9 * money, 6).alias("health_per_km"), F.round(6200 * money, 4).alias("health_cap"), F.round("users", 4).alias("users"), F.round("km", 4).alias("km"))


_COMBINATIONS = "combos AS (SELECT scenario, purpose FROM (VALUES ('baseline'), ('government'), ('go_dutch'), ('ebike'), ('target')) a(scenario) CROSS JOIN (VALUES ('commute'), ('school'), ('everyday'), ('transit'), ('all'), ('appraisal')) b(purpose))"


@query(with_("path_edges paths ods project_edges projects", f""", {_ACTIVITY}, {_COMBINATIONS}, g AS (SELECT candidate, sum(addition) AS value FROM added GROUP BY 1)
SELECT candidate, scenario, purpose, CASE WHEN purpose = 'commute' AND scenario <> 'baseline' THEN round(value, 4) END AS value, CASE WHEN purpose = 'appraisal' THEN 'withheld_until_reviewed' WHEN purpose NOT IN ('commute', 'all') AND scenario <> 'baseline' THEN 'not_modelled_for_purpose' WHEN purpose = 'all' THEN 'units_differ_between_purposes' WHEN scenario = 'baseline' THEN 'no_change_in_baseline' WHEN value IS NULL THEN 'no_demand' ELSE 'available' END AS status
FROM projects CROSS JOIN combos LEFT JOIN g USING (candidate)"""))
def metric_availability(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate under all 30 pairs of scenario and purpose: a value, or why there is none."""
    names = [F.array(*map(F.lit, x)) for x in (("baseline", "government", "go_dutch", "ebike", "target"), ("commute", "school", "everyday", "transit", "all", "appraisal"))]
    gains = _activity(spark, d).groupBy("candidate").agg(F.sum("addition").alias("gain"))
    rows = X.projects(spark, d).select("candidate").join(gains, "candidate", "left").select("*", F.explode(names[0]).alias("scenario")).select("*", F.explode(names[1]).alias("purpose"))
    p, base = F.col("purpose"), F.col("scenario") == "baseline"
    status = F.when(p == "appraisal", "withheld_until_reviewed").when(~p.isin("commute", "all") & ~base, "not_modelled_for_purpose").when(p == "all", "units_differ_between_purposes").when(base, "no_change_in_baseline").when(F.col("gain").isNull(), "no_demand").otherwise("available")
    return rows.select("candidate", "scenario", "purpose", F.when((p == "commute") & ~base, F.round("gain", 4)).alias("value"), status.alias("status"))


@query(with_("streets project_edges", f""", {_STRESS}, e AS (SELECT candidate, edge, road_class, length_m, lts, sum(length_m) OVER (PARTITION BY candidate ORDER BY edge) / sum(length_m) OVER (PARTITION BY candidate) AS upto, length_m / sum(length_m) OVER (PARTITION BY candidate) AS own FROM levels JOIN project_edges USING (edge))
SELECT candidate, edge, round(upto - own, 9) AS "from", round(upto, 9) AS "to", CAST(lts AS INTEGER) AS lts FROM e"""))
def candidate_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Where each edge lies along its candidate, as shares of the length; lengths are summed first and joined, a candidate's edges are one window."""
    rows = _levels(spark, d).select("edge", "length_m", "lts").join(X.project_edges(spark, d).select("edge", "candidate"), "edge")
    total = rows.groupBy("candidate").agg(F.sum("length_m").alias("all"))
    run = F.sum("length_m").over(Window.partitionBy("candidate").orderBy("edge").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("run", run).join(total, "candidate")
    return rows.select("candidate", "edge", F.round((F.col("run") - F.col("length_m")) / F.col("all"), 9).alias("from"), F.round(F.col("run") / F.col("all"), 9).alias("to"), F.col("lts").cast("int").alias("lts"))


@query("""WITH n AS (SELECT p_brand AS candidate, list(p_type ORDER BY p_partkey) AS names FROM part GROUP BY 1) SELECT candidate, array_to_string(names[1:2], ' / ') AS title FROM n""")
def build_titles(spark: SparkSession, d: str) -> DataFrame:
    """A build order's titles: the first two road names of each candidate. Only the first two are carried through the aggregation."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("candidate"), F.col("p_type").alias("name"), F.col("p_partkey").alias("place"))
    first = rows.groupBy("candidate").agg(F.min(F.struct("place", "name")).alias("a"))
    second = rows.join(first, "candidate").where(F.col("place") > F.col("a.place")).groupBy("candidate").agg(F.min(F.struct("place", "name")).alias("b"))
    return first.join(second, "candidate", "left").select("candidate", F.concat_ws(" / ", "a.name", "b.name").alias("title"))


@query("""WITH s AS (SELECT o_orderkey AS id, 'strategic' AS source, CASE o_orderstatus WHEN 'F' THEN 'committed' ELSE 'strategic' END AS status FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT s_suppkey, 'regional', CASE WHEN s_acctbal > 5000 THEN 'committed' WHEN s_acctbal > 0 THEN 'planned' ELSE 'strategic' END FROM supplier) SELECT source, status, count(*) AS n FROM s GROUP BY 1, 2""")
def programme_layer(spark: SparkSession, d: str) -> DataFrame:
    """Two programmes in one layer, each with its own words for how far a project is."""
    one = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("strategic").alias("source"), F.when(F.col("o_orderstatus") == "F", "committed").otherwise("strategic").alias("status"))
    two = table(spark, d, "supplier").select(F.lit("regional").alias("source"), F.when(F.col("s_acctbal") > 5000, "committed").when(F.col("s_acctbal") > 0, "planned").otherwise("strategic").alias("status"))
    return one.unionByName(two).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id % 40 AS site, user_id AS device, sum(value) AS n FROM events GROUP BY 1, 2), k AS (SELECT c_custkey AS device, c_custkey % 40 AS site FROM customer) SELECT coalesce(k.site, -1) AS site, count(*) AS devices, round(sum(n), 6) AS n, CASE WHEN k.site IS NULL THEN 'device_without_site' ELSE 'summed' END AS status FROM g LEFT JOIN k USING (device) GROUP BY 1, 4""")
def site_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of devices summed by site; a device of no known site stays, with the reason."""
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("device")).agg(F.sum("value").alias("n"))
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("device"), (F.col("c_custkey") % 40).alias("site"))
    rows = counts.join(sites, "device", "left")
    return rows.groupBy(F.coalesce("site", F.lit(-1)).alias("site"), F.when(F.col("site").isNull(), "device_without_site").otherwise("summed").alias("status")).agg(F.count("*").alias("devices"), F.round(F.sum("n"), 6).alias("n"))


@query("""WITH s AS (SELECT seed, size, c_nationkey AS cell, c_custkey AS support, row_number() OVER (PARTITION BY seed, size, c_nationkey ORDER BY sha256(seed || '|' || c_custkey), c_custkey) AS r FROM customer CROSS JOIN (VALUES (1), (2), (3)) a(seed) CROSS JOIN (VALUES (5), (25)) b(size)),
m AS (SELECT seed, size, cell, avg(support % 100) AS mean FROM s WHERE r <= size GROUP BY 1, 2, 3) SELECT size, cell, count(*) AS seeds, round(avg(mean), 8) AS mean, round(max(mean) - min(mean), 8) AS spread FROM m GROUP BY 1, 2""")
def support_stability(spark: SparkSession, d: str) -> DataFrame:
    """How a sampled mean of each cell moves over seeds and sample sizes."""
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(n).alias("size")) for s in (1, 2, 3) for n in (5, 25)]))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("cell"), F.col("c_custkey").alias("support"), grid.alias("g")).select("cell", "support", "g.*")
    place = F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("support").cast("string")), 256)
    parts = rows.withColumns({"place": place, "part": F.pmod(F.xxhash64("support"), F.lit(16))})
    few = parts.withColumn("r", F.row_number().over(Window.partitionBy("seed", "size", "cell", "part").orderBy("place", "support"))).where("r <= size")  # so that a hot cell is not ranked in one task
    taken = few.withColumn("r", F.row_number().over(Window.partitionBy("seed", "size", "cell").orderBy("place", "support"))).where("r <= size")
    means = taken.groupBy("seed", "size", "cell").agg(F.avg(F.col("support") % 100).alias("mean"))
    return means.groupBy("size", "cell").agg(F.count("*").alias("seeds"), F.round(F.avg("mean"), 8).alias("mean"), F.round(F.max("mean") - F.min("mean"), 8).alias("spread"))


@query("""WITH o AS (SELECT o_orderkey AS od, o_custkey AS origin, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) THEN NULL ELSE o_custkey % 40 END AS a, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 40 END AS z FROM orders)
SELECT od, a AS origin_node, z AS destination_node, CASE WHEN a IS NULL AND z IS NULL THEN 'missing_origin_and_destination' WHEN a IS NULL THEN 'missing_origin' WHEN z IS NULL THEN 'missing_destination' WHEN a % 2 <> z % 2 THEN 'disconnected_components' END AS failure, a IS NOT NULL AND z IS NOT NULL AND a % 2 = z % 2 AS snapped FROM o""")
def snap_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The base ledger of journeys with the nodes of both ends, and why one that has no pair in one component fails."""
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("rich"))
    rows = table(spark, d, "orders").join(rich, "o_custkey", "left")
    a, z = F.when(F.col("rich").isNull(), F.col("o_custkey") % 40), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderkey") % 40)
    rows = rows.select(F.col("o_orderkey").alias("od"), a.alias("a"), z.alias("z"))
    lost = F.when(F.col("a").isNull() & F.col("z").isNull(), "missing_origin_and_destination").when(F.col("a").isNull(), "missing_origin").when(F.col("z").isNull(), "missing_destination").when(F.col("a") % 2 != F.col("z") % 2, "disconnected_components")
    return rows.select("od", F.col("a").alias("origin_node"), F.col("z").alias("destination_node"), lost.alias("failure"), F.coalesce(F.col("a") % 2 == F.col("z") % 2, F.lit(False)).alias("snapped"))


@query("""WITH trips AS (SELECT user_id AS platform, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id // 3 END AS parent, CAST(json_extract(props, '$.k') AS BIGINT) AS service, CAST(ts AS DATE) AS day, event_type FROM events), cal AS (SELECT service, day, CASE WHEN service % 9 = 0 AND dayofweek(day) = 0 THEN 'removed' WHEN service % 11 = 0 THEN 'added' WHEN dayofweek(day) BETWEEN 1 AND 5 OR service % 2 = 0 THEN 'runs' END AS runs FROM (SELECT DISTINCT service, day FROM trips)),
on_day AS (SELECT coalesce(parent, platform + 1000000) AS stop, platform, event_type FROM trips JOIN cal USING (service, day) WHERE runs IN ('runs', 'added')), s AS (SELECT stop, count(DISTINCT platform) AS platforms, count(*) AS visits, count(*) FILTER (event_type = 'click') AS rail, count(*) FILTER (event_type = 'signup') AS ferry, count(*) FILTER (event_type NOT IN ('click', 'signup')) AS bus FROM on_day GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY bus DESC, stop) AS n, count(*) OVER () AS k FROM s) SELECT stop, platforms, visits, concat_ws(',', CASE WHEN rail > 20 THEN 'rail' END, CASE WHEN ferry > 15 THEN 'ferry' END, CASE WHEN n <= greatest(1, ceil(k * 0.05e0)) THEN 'busiest_bus' END) AS reasons FROM r""")
def major_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops of services that run on the day by calendar and exceptions, platforms put to their parent, with the reasons that make one major."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("platform"), F.get_json_object("props", "$.k").cast("long").alias("service"), F.to_date("ts").alias("day"), F.col("event_type").alias("e"))
    s, weekday = F.col("service"), F.dayofweek("day")
    runs = F.when((s % 9 == 0) & (weekday == 1), False).when(s % 11 == 0, True).otherwise(weekday.between(2, 6) | (s % 2 == 0))
    stop = F.when(F.col("platform") % 5 == 0, F.col("platform") + 1000000).otherwise(F.floor(F.col("platform") / 3))
    counts = rows.where(F.coalesce(runs, F.lit(False))).groupBy(stop.alias("stop")).agg(F.count_distinct("platform").alias("platforms"), F.count("*").alias("visits"), F.count_if(F.col("e") == "click").alias("rail"), F.count_if(F.col("e") == "signup").alias("ferry"), F.count_if(~F.col("e").isin("click", "signup")).alias("bus"))
    counts = _save(counts)
    ranked = R.carried(counts, [F.desc("bus"), F.col("stop")], F.lit(1), "n").crossJoin(counts.agg(F.count("*").alias("k")))  # one row
    reasons = F.concat_ws(",", F.when(F.col("rail") > 20, "rail"), F.when(F.col("ferry") > 15, "ferry"), F.when(F.col("n") <= F.greatest(F.lit(1), F.ceil(F.col("k") * 0.05)), "busiest_bus"))
    return ranked.select("stop", "platforms", "visits", reasons.alias("reasons"))
