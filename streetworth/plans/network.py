"""Queries on networks, demand markets and audits of ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.functions import columns as C
from streetworth.operators import graph as G
from streetworth.operators import network as N
from streetworth.operators import relational as R
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table, with_
from streetworth.queries import _POINTS, _STRESS, _levels, _near, _nearest
from streetworth.registry import query

_SEGMENTS = """stops AS (SELECT DISTINCT l_orderkey AS way, l_partkey * 10 + l_linenumber AS place, l_partkey % 500 AS node FROM lineitem),
segments AS (SELECT way, segment, node AS u, v FROM (SELECT *, row_number() OVER (PARTITION BY way ORDER BY place) - 1 AS segment, lead(node) OVER (PARTITION BY way ORDER BY place) AS v FROM stops) WHERE v IS NOT NULL AND v <> node)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    stops = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_partkey") % 500).alias("node")).distinct()
    return N.segments(stops)


@query(f"WITH {_SEGMENTS} SELECT concat('way-', way, '-segment-', segment) AS edge, u, v FROM segments")
def way_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select(F.concat(F.lit("way-"), "way", F.lit("-segment-"), "segment").alias("edge"), "u", "v")


@query(f"""WITH {_SEGMENTS}, arcs AS (SELECT way, segment, u, v, true AS forward FROM segments WHERE way % 3 <> 2 UNION ALL SELECT way, segment, v, u, false FROM segments WHERE way % 3 <> 1)
SELECT u, count(*) AS arcs, count(DISTINCT v) AS neighbours, count(*) FILTER (forward) AS forward FROM arcs GROUP BY 1""")
def directed_degrees(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("way") % 3 == 1, "forward").when(F.col("way") % 3 == 2, "reverse").otherwise("both")
    arcs = N.directed(_segments(spark, d).select(F.concat_ws("-", "way", "segment").alias("edge"), "u", "v", kind.alias("direction")))
    return arcs.groupBy("u").agg(F.count("*").alias("arcs"), F.count_distinct("v").alias("neighbours"), F.count_if("forward").alias("forward"))


@query("""WITH RECURSIVE o AS (SELECT way, place, length, row_number() OVER (PARTITION BY way ORDER BY place) AS i FROM (SELECT l_orderkey AS way, l_linenumber AS place, sum(l_quantity) AS length FROM lineitem GROUP BY 1, 2)),
r AS (SELECT way, place, length, i, 0 AS part, length AS run FROM o WHERE i = 1 UNION ALL SELECT o.way, o.place, o.length, o.i, CASE WHEN run + o.length > 60 THEN part + 1 ELSE part END, CASE WHEN run + o.length > 60 THEN o.length ELSE run + o.length END FROM r JOIN o ON o.way = r.way AND o.i = r.i + 1)
SELECT way, part, count(*) AS edges, sum(length) AS length FROM r GROUP BY 1, 2""")
def chain_split(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each way, none longer than 60 unless a single edge is."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("place")).agg(F.sum("l_quantity").alias("length"))
    return N.split_by_length(rows, "way", "place", "length", 60.0).groupBy("way", "part").agg(F.count("*").alias("edges"), F.sum("length").alias("length"))


@query("WITH RECURSIVE " + with_("streets", f""", {_STRESS}, e AS (SELECT edge AS id, edge * 7 % 997 AS u, edge * 13 % 997 AS v FROM levels WHERE lts > 2 AND facility NOT IN ('protected', 'shared', 'quiet_street') AND edge * 7 % 997 <> edge * 13 % 997), ends AS (SELECT id, u AS node FROM e UNION ALL SELECT id, v FROM e),
sizes AS (SELECT node, count(*) AS degree, min(id) AS a, max(id) AS b FROM ends GROUP BY 1), links AS (SELECT a, b FROM sizes WHERE degree = 2 AND a <> b UNION SELECT b, a FROM sizes WHERE degree = 2 AND a <> b), reach AS (SELECT a AS x, a AS y FROM links UNION SELECT x, b FROM reach JOIN links ON y = a), comp AS (SELECT x AS id, min(y) AS chain FROM reach GROUP BY 1),
named AS (SELECT e.id, coalesce(chain, e.id) AS chain FROM e LEFT JOIN comp USING (id)), outer_ AS (SELECT chain, count(DISTINCT node) AS tips, count(*) AS touches, max(id) AS last, count(DISTINCT id) AS n FROM ends JOIN sizes USING (node) JOIN named USING (id) WHERE degree <> 2 GROUP BY 1),
cut AS (SELECT id, CASE WHEN tips = 1 AND touches = 2 AND n = 2 AND id = last THEN id ELSE chain END AS chain, tips IS NULL AS closed FROM named LEFT JOIN outer_ USING (chain)) SELECT id, min(id) OVER (PARTITION BY chain) AS chain, closed FROM cut""").removeprefix("WITH "))
def gap_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of stressful parts, each part an edge between two of as many nodes as half the parts."""
    gaps = _levels(spark, d).where("lts > 2 and facility not in ('protected', 'shared', 'quiet_street')")
    n = 997
    return N.chains(gaps.select(F.col("edge").alias("id"), (F.col("edge") * 7 % n).alias("u"), (F.col("edge") * 13 % n).alias("v")).where("u <> v"))


@query(with_("streets", f", {_STRESS}, total AS (SELECT sum(length_m) AS m FROM levels) SELECT CAST(lts AS INTEGER) AS lts, count(*) AS edges, round(sum(length_m) / m, 8) AS share, round(quantile_cont(abs(gradient), 0.5), 8) AS p50, round(quantile_cont(abs(gradient), 0.9), 8) AS p90 FROM levels, total GROUP BY lts, m"))
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    found = _levels(spark, d).groupBy(F.col("lts").cast("int").alias("lts")).agg(F.count("*").alias("edges"), F.sum("length_m").alias("m"), *(F.round(F.percentile(F.abs("gradient"), F.lit(p)), 8).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9))))
    return found.select("lts", "edges", F.round(F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(0))), 8).alias("share"), "p50", "p90")  # at most four rows


@query(with_("streets project_edges", f", {_STRESS} SELECT candidate, round(sum(length_m), 4) AS length, CAST(max(lts) AS INTEGER) AS worst, round(sum(length_m * lts) / sum(length_m), 8) AS mean_lts, array_to_string(list_sort(list_distinct(list(road_class))), '/') AS classes, bool_or(bridge) AS bridge FROM levels JOIN project_edges USING (edge) GROUP BY 1"))
def candidate_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = _levels(spark, d).join(X.project_edges(spark, d), "edge")
    mean = F.sum(F.col("length_m") * F.col("lts")) / F.sum("length_m")
    return rows.groupBy("candidate").agg(F.round(F.sum("length_m"), 4).alias("length"), F.max("lts").cast("int").alias("worst"), F.round(mean, 8).alias("mean_lts"), F.array_join(F.sort_array(F.collect_set("road_class")), "/").alias("classes"), F.bool_or("bridge").alias("bridge"))


_FLOWS = "flows AS (SELECT CASE l_linestatus WHEN 'O' THEN 'commute' ELSE 'school' END AS purpose, l_partkey AS edge, sum(l_quantity) AS flow FROM lineitem GROUP BY 1, 2)"


@query(with_("project_edges", f", {_FLOWS} SELECT candidate, purpose, round(sum(coalesce(flow, 0e0) * p_retailprice / 1000e0), 6) AS person_km, max(coalesce(flow, 0e0)) AS most, min(coalesce(flow, 0e0)) AS least, count(*) FILTER (flow > 0) AS used FROM project_edges JOIN part ON p_partkey = edge CROSS JOIN (VALUES ('commute'), ('school')) v(purpose) LEFT JOIN flows USING (purpose, edge) GROUP BY 1, 2"))
def candidate_purpose_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Flows on each candidate's edges by purpose; edges without a flow count as 0."""
    flows = table(spark, d, "lineitem").groupBy(F.when(F.col("l_linestatus") == "O", "commute").otherwise("school").alias("purpose"), F.col("l_partkey").alias("edge")).agg(F.sum("l_quantity").alias("flow"))
    edges = X.project_edges(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("edge"), "p_retailprice"), "edge").withColumn("purpose", F.explode(F.array(F.lit("commute"), F.lit("school"))))
    rows = edges.join(flows, ["purpose", "edge"], "left").fillna(0.0, ["flow"])
    return rows.groupBy("candidate", "purpose").agg(F.round(F.sum(F.col("flow") * F.col("p_retailprice") / 1000), 6).alias("person_km"), F.max("flow").alias("most"), F.min("flow").alias("least"), F.count_if(F.col("flow") > 0).alias("used"))


@query(with_("path_edges streets", """ SELECT od, path, round(100 * sum(abs(gradient) * length_m) / sum(length_m), 8) AS mean_gradient, round(sum(greatest(0e0, gradient) * length_m), 6) AS ascent, round(sum(greatest(0e0, -gradient) * length_m), 6) AS descent FROM path_edges JOIN streets USING (edge) GROUP BY 1, 2"""))
def path_gradients(spark: SparkSession, d: str) -> DataFrame:
    rows = X.path_edges(spark, d).join(X.streets(spark, d).select("edge", "gradient", "length_m"), "edge")
    rise = F.col("gradient") * F.col("length_m")
    return rows.groupBy("od", "path").agg(F.round(100 * F.sum(F.abs(rise)) / F.sum("length_m"), 8).alias("mean_gradient"), F.round(F.sum(F.greatest(F.lit(0.0), rise)), 6).alias("ascent"), F.round(F.sum(F.greatest(F.lit(0.0), -rise)), 6).alias("descent"))


@query(with_("path_edges paths", """, met AS (SELECT a.od, a.path, b.path AS other, sum(a.cost) AS shared FROM path_edges a JOIN path_edges b ON a.od = b.od AND a.edge = b.edge AND a.path <> b.path GROUP BY 1, 2, 3)
SELECT od, path, other, round(shared / cost, 8) AS ratio FROM met JOIN paths USING (od, path)"""))
def shared_length_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of each path that another path of the same pair of places also uses."""
    edges = X.path_edges(spark, d)
    other = edges.select("od", "edge", F.col("path").alias("other"))
    met = edges.join(other, ["od", "edge"]).where("path <> other").groupBy("od", "path", "other").agg(F.sum("cost").alias("shared"))
    return met.join(X.paths(edges), ["od", "path"]).select("od", "path", "other", F.round(F.col("shared") / F.col("cost"), 8).alias("ratio"))


@query(f"""WITH {_POINTS}, two AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM p WHERE distance <= 3000),
best AS (SELECT a, min_by(b, r) AS b, min(distance) AS distance, count(*) = 1 OR max(distance) - min(distance) >= 200 AS clear FROM two WHERE r <= 2 GROUP BY 1),
won AS (SELECT b, min_by(a, (distance, a)) AS winner FROM best WHERE clear GROUP BY 1)
SELECT a, best.b, round(distance, 6) AS distance, CASE WHEN NOT clear THEN 'ambiguous' WHEN winner = a THEN 'matched' ELSE 'taken' END AS status FROM best LEFT JOIN won USING (b)""")
def unambiguous_nearest(spark: SparkSession, d: str) -> DataFrame:
    return N.nearest_two(_nearest(spark, d, 2, 3000.0), 200.0).select("a", "b", F.round("distance", 6).alias("distance"), "status")


@query(f"""WITH {_POINTS}, near AS (SELECT a, b AS node, b % 3 AS component, distance FROM p WHERE distance <= 4000),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, component ORDER BY distance, node) AS r FROM near) WHERE r <= 2),
ods AS (SELECT o_orderkey AS od, o_custkey AS a, 1 + (o_custkey * 31 + o_orderkey) % (SELECT max(c_custkey) FROM customer) AS z FROM orders),
met AS (SELECT od, x.component, x.node AS a_node, y.node AS z_node, x.distance + y.distance AS total, greatest(x.distance, y.distance) AS most FROM ods JOIN two x USING (a) JOIN two y ON y.a = ods.z AND x.component = y.component WHERE x.node <> y.node),
best AS (SELECT *, row_number() OVER (PARTITION BY od ORDER BY total, most, component, a_node, z_node) AS r FROM met)
SELECT od, component, a_node, z_node, round(total, 6) AS distance FROM best WHERE r = 1""")
def component_snaps(spark: SparkSession, d: str) -> DataFrame:
    part = X.points(spark, d, "supplier", "s_suppkey").toDF("b", "bx", "by").withColumn("component", F.col("b") % 3)
    ends = X.points(spark, d, "customer", "c_custkey").toDF("a", "ax", "ay").crossJoin(F.broadcast(part.select("component").distinct()))  # three rows
    near = G._save(R.nearest(ends, part, 2, 4000.0, ["component"]).select("a", F.col("b").alias("node"), "component", "distance"))
    last = table(spark, d, "customer").agg(F.max("c_custkey").alias("last"))
    orders = table(spark, d, "orders").crossJoin(F.broadcast(last))  # one row
    ods = orders.select(F.col("o_orderkey").alias("od"), F.col("o_custkey").alias("a"), (1 + (F.col("o_custkey") * 31 + F.col("o_orderkey")) % F.col("last")).alias("z"))
    return N.snap_pairs(ods, near, near.withColumnRenamed("a", "z")).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_POINTS}, lines AS (SELECT b, bx AS x1, by_ AS y1, bx + b % 7 * 150e0 AS x2, by_ + (b % 5 - 2) * 120e0 AS y2 FROM b),
t AS (SELECT a, b, ax, ay, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM a, lines), u AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, ((ax - x1) * dx + (ay - y1) * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS s FROM t),
v AS (SELECT a, b, sqrt((ax - x1 - s * dx) * (ax - x1 - s * dx) + (ay - y1 - s * dy) * (ay - y1 - s * dy)) AS distance, (degrees(atan2(dx, dy)) + 360) % 360 AS bearing FROM u)
SELECT a, b, round(distance, 6) AS distance, round(bearing, 6) AS bearing FROM v WHERE distance <= 400""")
def counter_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments within 400 m of each point, with their bearings."""
    points = X.points(spark, d, "customer", "c_custkey").toDF("a", "ax", "ay")
    b = F.col("id")
    lines = X.points(spark, d, "supplier", "s_suppkey").select(b.alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + b % 7 * 150.0).alias("x2"), (F.col("y") + (b % 5 - 2) * 120.0).alias("y2"))
    return N.near_segments(points, lines, 400.0).select("a", "b", F.round("distance", 6).alias("distance"), F.round("bearing", 6).alias("bearing"))


@query(f"""WITH {_POINTS}, w AS (SELECT a AS origin, b AS destination, 1e0 + a % 11 AS supply, 100e0 + b % 7 AS arrivals, distance FROM p WHERE distance <= 3000), e AS (SELECT *, supply * exp(-distance / 3000e0) AS k FROM w)
SELECT origin, destination, round(arrivals * k / sum(k) OVER (PARTITION BY destination), 8) AS trips FROM e""")
def gravity_trips(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d, 3000.0).select(F.col("a").alias("origin"), F.col("b").alias("destination"), (1.0 + F.col("a") % 11).alias("supply"), (100.0 + F.col("b") % 7).alias("arrivals"), "distance")
    return N.gravity(near, 3000.0).select("origin", "destination", F.round("trips", 8).alias("trips"))


@query(f"""WITH {_POINTS}, best AS (SELECT a, b % 4 AS category, min_by(b, (distance, b)) AS b, min(distance) AS distance FROM p WHERE distance <= 5000 GROUP BY 1, 2)
SELECT a, category, b, round((CASE category WHEN 0 THEN 0.4e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.2e0 ELSE 0.1e0 END) * (CASE WHEN distance <= 1200 THEN 1e0 ELSE exp(-(distance / 100 - 12) / 5) END), 8) AS trips FROM best""")
def everyday_market(spark: SparkSession, d: str) -> DataFrame:
    """Nearest destination of each category, with its share of trips after distance decay (points lie ten times as close as kilometres)."""
    best = _near(spark, d, 5000.0).groupBy("a", (F.col("b") % 4).alias("category")).agg(F.min_by("b", F.struct("distance", "b")).alias("b"), F.min("distance").alias("distance"))
    share = F.element_at(F.array(*map(F.lit, (0.4, 0.3, 0.2, 0.1))), (F.col("category") + 1).cast("int"))
    return best.select("a", "category", "b", F.round(share * C.distance_decay(F.col("distance") / 100), 8).alias("trips"))


@query("""WITH e AS (SELECT p_type, quantile_cont(p_size, 0.05) AS l1, quantile_cont(p_size, 0.95) AS h1, quantile_cont(p_retailprice, 0.05) AS l2, quantile_cont(p_retailprice, 0.95) AS h2 FROM part GROUP BY 1),
s AS (SELECT p_partkey, p_type, 0.7e0 * (CASE WHEN h1 > l1 THEN greatest(0e0, least(1e0, (p_size - l1) / (h1 - l1))) ELSE 0.5e0 END) + 0.3e0 * (CASE WHEN h2 > l2 THEN greatest(0e0, least(1e0, (p_retailprice - l2) / (h2 - l2))) ELSE 0.5e0 END) AS score FROM part JOIN e USING (p_type))
SELECT p_partkey, p_type, round(score, 8) AS score, row_number() OVER (PARTITION BY p_type ORDER BY round(score, 8) DESC, p_partkey) AS rank FROM s""")
def site_suitability(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    scored = N.robust_scale(rows, "p_type", ["p_size", "p_retailprice"]).withColumn("score", F.round(0.7 * F.col("p_size") + 0.3 * F.col("p_retailprice"), 8))
    return scored.select("p_partkey", "p_type", "score", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("score"), "p_partkey")).cast("long").alias("rank"))


@query("""WITH v AS (SELECT user_id AS stop, count(*) FILTER (event_type = 'view') AS bus, count(*) FILTER (event_type = 'click') AS rail, count(*) FILTER (event_type = 'signup') AS ferry, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS platforms FROM events GROUP BY 1)
SELECT stop, bus, rail, ferry, platforms, rank <= greatest(1, ceil(n * 0.1e0)) AS busiest FROM (SELECT *, row_number() OVER (ORDER BY bus DESC, stop) AS rank, count(*) OVER () AS n FROM v)""")
def busiest_stops(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each stop by mode, its platforms, and whether it is in the busiest tenth by bus."""
    e = F.col("event_type")
    stops = table(spark, d, "events").groupBy(F.col("user_id").alias("stop")).agg(F.count_if(e == "view").alias("bus"), F.count_if(e == "click").alias("rail"), F.count_if(e == "signup").alias("ferry"), F.count_distinct(F.get_json_object("props", "$.k").cast("long")).alias("platforms"))
    ranked = R.carried(stops, [F.desc("bus"), F.col("stop")], F.lit(1), "rank").crossJoin(stops.agg(F.count("*").alias("n")))  # one row
    return ranked.select("stop", "bus", "rail", "ferry", "platforms", (F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).alias("busiest"))


@query("""WITH r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2e0 AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2e0 AS y FROM part)
SELECT p_brand AS site, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1""")
def spearman_by_site(spark: SparkSession, d: str) -> DataFrame:
    average = lambda c: F.rank().over(Window.partitionBy("p_brand").orderBy(c)) + (F.count("*").over(Window.partitionBy("p_brand", c)) - 1) / 2.0
    ranked = table(spark, d, "part").select("p_brand", average("p_size").alias("x"), average("p_retailprice").alias("y"))
    return ranked.groupBy(F.col("p_brand").alias("site")).agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("spearman"))


@query("""WITH s AS (SELECT c_nationkey AS cell, o_orderpriority AS purpose, sum(o_totalprice) AS activity FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT cell, purpose, round(activity / max(activity) OVER (PARTITION BY purpose), 8) AS relative FROM s""")
def cell_layer(spark: SparkSession, d: str) -> DataFrame:
    """Activity of each cell against the purpose's largest; the maxima are aggregated and joined, as there are few purposes."""
    sums = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("cell"), F.col("o_orderpriority").alias("purpose")).agg(F.sum("o_totalprice").alias("activity"))
    most = sums.groupBy("purpose").agg(F.max("activity").alias("most"))
    return sums.join(most, "purpose").select("cell", "purpose", F.round(F.col("activity") / F.col("most"), 8).alias("relative"))


@query("""SELECT count(*) AS rows, count(*) FILTER (n > 1) AS repeated_keys, count(*) FILTER (o_orderkey IS NULL) AS orphans, count(*) FILTER (quantity <= 0) AS not_positive FROM
(SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) LEFT JOIN orders ON l_orderkey = o_orderkey""")
def path_ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """Violations of each rule, counted in one pass over the ledger's keys."""
    keys = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    met = keys.join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return met.agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("o_orderkey").isNull()).alias("orphans"), F.count_if(F.col("quantity") <= 0).alias("not_positive"))


@query("""WITH a AS (SELECT o_orderkey AS od, o_totalprice AS held FROM orders), b AS (SELECT l_orderkey AS od, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS rebuilt FROM lineitem GROUP BY 1)
SELECT count(*) AS ods, count(*) FILTER (rebuilt IS NULL) AS missing, count(*) FILTER (held IS NULL) AS stale, count(*) FILTER (abs(held - rebuilt) > 1e-6 * held) AS differing FROM a FULL JOIN b USING (od)""")
def flow_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The stored totals against totals summed again from the parts: missing, stale and differing ones."""
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("od"), F.col("o_totalprice").alias("held"))
    rebuilt = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("od")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("rebuilt"))
    both = held.join(rebuilt, "od", "full")
    return both.agg(F.count("*").alias("ods"), F.count_if(F.col("rebuilt").isNull()).alias("missing"), F.count_if(F.col("held").isNull()).alias("stale"), F.count_if(F.abs(F.col("held") - F.col("rebuilt")) > 1e-6 * F.col("held")).alias("differing"))


@query("""WITH RECURSIVE links AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey || ':' || CAST(floor(c_acctbal / 10) AS BIGINT) AS b FROM customer UNION SELECT 'c' || c_custkey, 's' || c_mktsegment || ':' || CAST(floor(c_acctbal / 5) AS BIGINT) FROM customer),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a AS x, a AS y FROM both_ UNION SELECT x, b FROM reach JOIN both_ ON y = a)
SELECT substr(x, 2) AS candidate, min(y) AS "group" FROM reach WHERE x LIKE 'c%' GROUP BY 1""")
def portfolio_groups(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that share an area, directly or through others: components of the graph of candidates and areas. Every customer is a candidate and touches two areas."""
    band = lambda w: F.floor(F.col("c_acctbal") / w).cast("string")
    areas = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(":"), band(10)), F.concat(F.lit("s"), "c_mktsegment", F.lit(":"), band(5)))
    links = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.explode(areas).alias("b"))
    return G.components(links).where("id like 'c%'").select(F.substring("id", 2, 100).alias("candidate"), F.col("component").alias("group"))


@query(with_("path_edges paths", """, s AS (SELECT od, path, cost, row_number() OVER (PARTITION BY od ORDER BY cost, path) AS option, cost / min(cost) OVER (PARTITION BY od) AS detour FROM paths) SELECT od, path, option, round(detour, 8) AS detour FROM s WHERE detour <= 1.5e0"""))
def route_options(spark: SparkSession, d: str) -> DataFrame:
    """Paths of each pair of places at most half as dear again as the best, in order."""
    own = Window.partitionBy("od")
    rows = X.paths(X.path_edges(spark, d)).withColumns({"option": F.row_number().over(own.orderBy("cost", "path")).cast("long"), "detour": F.col("cost") / F.min("cost").over(own)})
    return rows.where("detour <= 1.5").select("od", "path", "option", F.round("detour", 8).alias("detour"))


@query(with_("streets project_edges", """ SELECT edge, CASE WHEN right(candidate, 1) = '1' THEN 'protected' ELSE facility END AS facility FROM streets JOIN project_edges USING (edge)"""))
def treated_network(spark: SparkSession, d: str) -> DataFrame:
    """The street network with the funded candidates' edges protected."""
    chosen = X.project_edges(spark, d).where("candidate like '%1'").select("edge", F.lit("protected").alias("treatment"))
    return N.apply_treatments(X.streets(spark, d).select("edge", "facility"), chosen)
