"""Queries that audit ledgers. The ledgers are derived from the driver's tables, whose own irregularities (orders in states, repeated line numbers) are what the rules find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.operators import audits as A
from streetworth.operators import markets as M
from streetworth.operators import relational as R
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table, with_
from streetworth.plans.markets import _SUPPORTS
from streetworth.queries import _PROBABILITY
from streetworth.registry import query


def _rules(names: str, rows: str) -> str:
    """The same long form for DuckDB: one aggregation, unpivoted."""
    return f"SELECT rule, CAST(count AS BIGINT) AS count FROM (UNPIVOT ({rows}) ON {names} INTO NAME rule VALUE count)"


@query(with_("path_edges paths", f""", {_PROBABILITY}, ranked AS (SELECT o_orderkey AS od, o_custkey AS stratum, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('7|' || o_custkey || '|' || o_orderkey), o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
lists AS (SELECT od, list(path ORDER BY path) AS paths, list(probability ORDER BY path) AS ps FROM probs GROUP BY 1),
ledger AS (SELECT r.od, stratum, least(size, 5) AS stratum_sample, rank <= 5 AS selected, CASE WHEN rank <= 5 THEN size / least(size, 5)::DOUBLE ELSE 0e0 END AS weight, CASE WHEN rank > 5 THEN 'not_selected' WHEN o_orderstatus = 'P' THEN 'unassigned' ELSE 'assigned' END AS status,
  CASE WHEN rank <= 5 AND o_orderstatus = 'P' AND left(o_orderpriority, 1) <> '1' THEN 'disconnected_components' END AS reason, CASE WHEN rank <= 5 AND o_orderstatus <> 'P' THEN paths END AS paths, CASE WHEN rank <= 5 AND o_orderstatus <> 'P' THEN CASE WHEN left(o_orderpriority, 1) = '5' THEN ps[2:] ELSE ps END END AS ps FROM ranked r LEFT JOIN lists USING (od)),
st AS (SELECT stratum, count(*) FILTER (selected) AS n, min(stratum_sample) AS a, max(stratum_sample) AS b FROM ledger GROUP BY 1)
""" + _rules("*", """SELECT count(*) AS rows, count(*) FILTER (coalesce(len(paths), 0) <> coalesce(len(ps), 0)) AS list_lengths_differ, count(*) FILTER (selected AND NOT weight > 0) AS selected_without_weight, count(*) FILTER (selected AND status NOT IN ('assigned', 'unassigned')) AS selected_with_unknown_status,
count(*) FILTER (NOT selected AND status <> 'not_selected') AS unselected_with_other_status, count(*) FILTER (NOT selected AND (coalesce(len(paths), 0) > 0 OR weight <> 0)) AS unselected_with_paths_or_weight, count(*) FILTER (status = 'assigned' AND coalesce(len(paths), 0) = 0) AS assigned_without_paths,
count(*) FILTER (status = 'assigned' AND reason IS NOT NULL) AS assigned_with_reason, count(*) FILTER (status = 'assigned' AND coalesce(len(ps), 0) > 0 AND abs(list_sum(ps) - 1) > 1e-12) AS probabilities_not_one, count(*) FILTER (status = 'unassigned' AND reason IS NULL) AS failed_without_reason,
count(*) FILTER (status = 'unassigned' AND coalesce(len(paths), 0) > 0) AS failed_with_paths, count(*) - count(DISTINCT od) AS repeated_od, (SELECT count(*) FILTER (n <> a OR a <> b) FROM st) AS stratum_sample_differs FROM ledger""")))
def od_ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """A sampled ledger in which urgent failures have no reason and slow orders lack a probability."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("od"), F.col("o_custkey").alias("stratum"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    own = Window.partitionBy("stratum")
    place = F.sha2(F.concat_ws("|", F.lit("7"), F.col("stratum").cast("string"), F.col("od").cast("string")), 256)
    orders = orders.withColumns({"rank": F.row_number().over(own.orderBy(place, "od")), "size": F.count("*").over(own)})
    paths = R.path_probabilities(X.paths(X.path_edges(spark, d)), X.THETA)
    lists = paths.groupBy("od").agg(F.sort_array(F.collect_list(F.struct("path", "probability"))).alias("l"))
    taken, failed = F.col("rank") <= 5, F.col("o_orderstatus") == "P"
    sample = F.least(F.col("size"), F.lit(5))
    probabilities = F.transform("l", lambda x: x["probability"])
    short = F.when(F.col("p") == "5", F.slice(probabilities, 2, F.greatest(F.size(probabilities) - 1, F.lit(0)))).otherwise(probabilities)
    return A.od_ledger(orders.join(lists, "od", "left").select(
        "od", "stratum", sample.alias("stratum_sample"), taken.alias("selected"), F.when(taken, F.col("size") / sample).otherwise(0.0).alias("weight"), F.when(~taken, "not_selected").when(failed, "unassigned").otherwise("assigned").alias("status"),
        F.when(taken & failed & (F.col("p") != "1"), "disconnected_components").alias("reason"), F.when(taken & ~failed, F.transform("l", lambda x: x["path"])).alias("paths"), F.when(taken & ~failed, short).alias("probabilities"),
    ))


@query(with_("ods", """, units AS (SELECT o_orderkey AS od, coalesce(eligible, 10e0) AS eligible, coalesce(base, 0e0) AS observed, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'assigned' END AS status FROM orders LEFT JOIN ods ON od = o_orderkey),
ledger AS (SELECT l_linenumber % 5 AS scenario, l_orderkey AS od, CASE WHEN l_tax < 0.005 THEN NULL ELSE l_quantity * 2 END AS users FROM lineitem), k AS (SELECT od, count(*) AS kinds, max(n) AS most FROM (SELECT od, scenario, count(*) AS n FROM ledger GROUP BY 1, 2) GROUP BY 1), r AS (SELECT * FROM ledger JOIN units USING (od))
""" + _rules("*", """SELECT count(*) AS rows, count(*) FILTER (status = 'assigned' AND users < observed - 1e-9) AS below_observed, count(*) FILTER (status = 'assigned' AND users > eligible + 1e-9) AS above_eligible, count(*) FILTER (status = 'assigned' AND users IS NULL) AS assigned_without_users, count(*) FILTER (status <> 'assigned' AND users IS NOT NULL) AS users_without_route,
(SELECT count(*) FILTER (coalesce(kinds, 0) < 5) FROM units LEFT JOIN k USING (od)) AS unit_lacks_scenarios, (SELECT count(*) FILTER (most > 1) FROM k) AS repeated_rows, (SELECT count(*) FROM k WHERE od NOT IN (SELECT od FROM units)) AS unknown_units FROM r""")))
def scenario_ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """Order lines taken as a stored scenario ledger, held against the orders as units."""
    ods = X.ods(spark, d).withColumnRenamed("base", "observed")
    units = table(spark, d, "orders").select(F.col("o_orderkey").alias("od"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("assigned").alias("status")).join(ods, "od", "left").fillna({"eligible": 10.0, "observed": 0.0})
    ledger = table(spark, d, "lineitem").select((F.col("l_linenumber") % 5).alias("scenario"), F.col("l_orderkey").alias("od"), F.when(F.col("l_tax") >= 0.005, F.col("l_quantity") * 2).alias("users"))
    return A.scenario_ledger(ledger, units)


@query(f"""WITH {_SUPPORTS}, spread AS (SELECT cell, mass * CASE WHEN origin = 3 THEN 0.9e0 ELSE 1e0 END AS mass FROM sized WHERE destination <> 7 UNION ALL SELECT -1, 5e0), s AS (SELECT cell, sum(mass) AS s FROM spread GROUP BY 1)
""" + _rules("*", "SELECT count(*) AS rows, count(*) FILTER (abs(mass - s) > 1e-6) AS mass_differs, count(*) FILTER (s IS NULL) AS cell_without_parts, count(*) FILTER (mass IS NULL) AS parts_without_cell FROM cells FULL JOIN s USING (cell)"))
def mass_conservation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Zone pairs against their spread over homes and jobs, in which one origin lost a tenth, one destination is missing and one part has no cell."""
    homes = table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_custkey").alias("support"), (1.0 + F.col("c_custkey") % 9).alias("weight"))
    jobs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("support"), (1.0 + F.col("s_suppkey") % 5).alias("weight"))
    a, b = (table(spark, d, "nation").select(F.col("n_nationkey").alias(n)) for n in ("origin", "destination"))
    cells = a.crossJoin(b).select((F.col("origin") * 25 + F.col("destination")).alias("cell"), "origin", "destination", (1.0 + (F.col("origin") * 3 + F.col("destination")) % 11).alias("mass"))
    parts = M.disaggregate(cells, homes, jobs, 25, "20260301").join(cells.select("cell", "origin", "destination"), "cell").where("destination <> 7")
    parts = parts.select("cell", (F.col("mass") * F.when(F.col("origin") == 3, 0.9).otherwise(1.0)).alias("mass"))
    return A.mass(parts.unionByName(spark.createDataFrame([(-1, 5.0)], "cell int, mass double")), cells)


@query("""WITH e AS (SELECT c_custkey AS origin, k AS category FROM customer, range(3) t(k)), r AS (SELECT o_custkey AS origin, o_orderkey % 3 AS category FROM orders), t AS (SELECT origin, category, count(*) AS times FROM r GROUP BY 1, 2)
SELECT coalesce(e.origin, t.origin) AS origin, CAST(coalesce(e.category, t.category) AS BIGINT) AS category, coalesce(times, 0) AS times, e.origin IS NOT NULL AS expected FROM e FULL JOIN t ON e.origin = t.origin AND e.category = t.category WHERE e.origin IS NULL OR times IS NULL OR times <> 1""")
def origin_category_once(spark: SparkSession, d: str) -> DataFrame:
    """Origins and categories that are not accounted for exactly once by records and exclusions together."""
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("origin"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("category"))
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("origin"), (F.col("o_orderkey") % 3).alias("category"))
    return A.exactly_once(have, want, ["origin", "category"])


@query("""WITH sources AS (SELECT s_suppkey AS source, (['permitted','unknown','restricted'])[s_suppkey % 3 + 1] AS known FROM supplier WHERE s_nationkey <> 4), d AS (SELECT s_suppkey AS source, 1 + CAST(s_suppkey % 31 = 0 AS INTEGER) AS n, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 13 = 0 THEN 'include' ELSE 'exclude' END AS decision,
  (['permitted','unknown','restricted'])[(s_suppkey + CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS said FROM supplier WHERE s_nationkey <> 9), used AS (SELECT l_suppkey AS source, count(DISTINCT l_linenumber) AS uses FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY 1),
m AS (SELECT coalesce(s.source, d.source, u.source) AS source, known, n, decision, said, uses FROM sources s FULL JOIN d USING (source) FULL JOIN used u ON u.source = coalesce(s.source, d.source))
SELECT source, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated_decision' END, CASE WHEN known IS NOT NULL AND n IS NULL THEN 'no_decision' END, CASE WHEN n IS NOT NULL AND known IS NULL THEN 'unregistered_source' END, CASE WHEN said <> known THEN 'redistribution_differs' END, CASE WHEN uses IS NOT NULL AND n IS NULL THEN 'used_without_decision' END,
CASE WHEN decision = 'exclude' AND uses IS NOT NULL THEN 'excluded_but_used' END, CASE WHEN decision <> 'exclude' AND said IN ('unknown', 'restricted') THEN 'must_be_excluded' END, CASE WHEN decision <> 'exclude' AND uses IS NULL THEN 'included_but_not_used' END], lambda x: x IS NOT NULL)) AS issue FROM m""")
def rights_gate(spark: SparkSession, d: str) -> DataFrame:
    """Sources (suppliers) whose decisions, registration and use in layers break a rule of publication."""
    k = F.col("s_suppkey")
    name = lambda i: F.get(F.array(*map(F.lit, ("permitted", "unknown", "restricted"))), (i % 3).cast("int"))
    suppliers = table(spark, d, "supplier")
    sources = suppliers.where("s_nationkey <> 4").select(k.alias("source"), name(k).alias("redistribution"))
    said = suppliers.where("s_nationkey <> 9").select(k.alias("source"), name(k + F.when(k % 17 == 0, 1).otherwise(0)).alias("redistribution"), F.when((k % 3 == 0) | (k % 13 == 0), "include").otherwise("exclude").alias("decision"))
    layers = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_linenumber").alias("layer"), F.col("l_suppkey").alias("source")).distinct()
    return A.rights(said.unionByName(said.where("source % 31 = 0")), layers, sources)


@query("""WITH steps AS (SELECT l_orderkey AS key, list(l_partkey ORDER BY l_linenumber, l_partkey) AS own, list_sort(list(l_partkey)) AS sorted FROM lineitem GROUP BY 1),
declared AS (SELECT l_orderkey AS key, list(CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 1 THEN l_partkey + 1 ELSE l_partkey END ORDER BY l_partkey) AS ids FROM lineitem GROUP BY 1)
SELECT o_orderkey AS key, CASE WHEN own IS NULL THEN NULL WHEN own = ids THEN 'match' WHEN sorted = list_sort(ids) THEN 'order_differs' ELSE 'set_differs' END AS status FROM orders JOIN steps ON key = o_orderkey JOIN declared USING (key)""")
def edge_order_audit(spark: SparkSession, d: str) -> DataFrame:
    """Each chain's edges in sequence against the order that is declared for it."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey").alias("place"), F.col("l_partkey").alias("id"), "l_linenumber")
    stated = F.when((F.col("key") % 11 == 0) & (F.col("l_linenumber") == 1), F.col("id") + 1).otherwise(F.col("id"))
    declared = lines.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", stated.alias("s")))), lambda x: x["s"]).alias("ids"))
    return A.order_matches(lines.select("key", "place", "id"), declared).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), "key")


@query("""WITH h AS (SELECT DISTINCT 'col' || user_id % 40 AS header FROM events), m AS (SELECT 'col' || i AS header, CASE WHEN i % 3 = 0 THEN 'excluded' ELSE 'mapped' END AS kind FROM range(5, 45) t(i))
SELECT coalesce(h.header, m.header) AS header, CASE WHEN m.header IS NULL THEN 'unmapped' WHEN h.header IS NULL THEN 'stale' ELSE kind END AS status FROM h FULL JOIN m ON h.header = m.header""")
def header_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Headers of a workbook against those that are mapped or excluded: what is new and what is gone."""
    headers = table(spark, d, "events").select(F.concat(F.lit("col"), (F.col("user_id") % 40).cast("string")).alias("header"), F.lit(True).alias("there")).distinct()
    known = spark.range(5, 45).select(F.concat(F.lit("col"), F.col("id").cast("string")).alias("header"), F.when(F.col("id") % 3 == 0, "excluded").otherwise("mapped").alias("kind"))
    return headers.join(known, "header", "full").select("header", F.when(F.col("kind").isNull(), "unmapped").when(F.col("there").isNull(), "stale").otherwise(F.col("kind")).alias("status"))


@query("""WITH m AS (SELECT p_brand || '-' || p_size AS zone, CASE WHEN p_retailprice > 1800 THEN -999 ELSE CAST(p_retailprice AS BIGINT) END AS n, count(*) OVER (PARTITION BY p_brand, p_size) AS k FROM part)
SELECT zone, k AS rows, CASE WHEN k > 1 THEN 'repeated_zone' ELSE 'ok' END AS status, CASE WHEN k = 1 THEN CASE WHEN min(n) = -999 THEN 0e0 ELSE greatest(0e0, min(n) - 2e0) END END AS lower, CASE WHEN k = 1 THEN CASE WHEN min(n) = -999 THEN 5e0 ELSE min(n) + 2e0 END END AS upper FROM m GROUP BY zone, k""")
def zone_margins(spark: SparkSession, d: str) -> DataFrame:
    """A published margin for each zone as an interval; a zone that comes twice has none, with the reason."""
    from streetworth.functions.columns import censored_interval

    p = F.col("p_retailprice")
    rows = table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("zone"), F.when(p > 1800, F.lit(-999)).otherwise(F.rint(p)).cast("long").alias("n"))
    sums = rows.groupBy("zone").agg(F.count("*").alias("rows"), F.min("n").alias("n")).withColumn("i", censored_interval(F.col("n")))
    one = F.col("rows") == 1
    return sums.select("zone", "rows", F.when(one, "ok").otherwise("repeated_zone").alias("status"), F.when(one, F.col("i.lower")).alias("lower"), F.when(one, F.col("i.upper")).alias("upper"))


@query("""WITH web AS (SELECT l_partkey AS edge, round(sum(l_quantity), 1) AS shown FROM lineitem GROUP BY 1), led AS (SELECT l_partkey AS edge, sum(l_quantity * CASE WHEN l_partkey % 50 = 0 AND l_returnflag = 'A' THEN 1.5e0 ELSE 1e0 END) AS held FROM lineitem GROUP BY 1), j AS (SELECT edge, abs(shown - held) AS gap FROM web JOIN led USING (edge)),
o AS (SELECT gap, row_number() OVER (ORDER BY gap, edge) - 1 AS i, count(*) OVER () AS n FROM j) SELECT q AS percentile, round(max(gap) FILTER (i = CAST(floor(q / 100e0 * (n - 1)) AS BIGINT)), 6) AS gap FROM o, (VALUES (50), (75), (90), (95), (99), (100)) v(q) GROUP BY 1""")
def ridership_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Shown against held flows of each edge: percentiles of the gap at index floor(q / 100 * (n - 1))."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("edge"), "l_quantity", "l_returnflag")
    wrong = F.when((F.col("edge") % 50 == 0) & (F.col("l_returnflag") == "A"), 1.5).otherwise(1.0)
    gaps = lines.groupBy("edge").agg(F.abs(F.round(F.sum("l_quantity"), 1) - F.sum(F.col("l_quantity") * wrong)).alias("gap"))
    placed = R.carried(gaps, [F.col("gap"), F.col("edge")], F.lit(1), "i").crossJoin(gaps.agg(F.count("*").alias("n")))  # one row
    wanted = placed.withColumn("percentile", F.explode(F.array(*map(F.lit, (50, 75, 90, 95, 99, 100))))).where(F.col("i") - 1 == F.floor(F.col("percentile") / 100.0 * (F.col("n") - 1)))
    return wanted.select("percentile", F.round("gap", 6).alias("gap"))


@query("""WITH s AS (SELECT s_suppkey AS path, s_nationkey AS n, lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS tile, md5(s_name) AS sha FROM supplier), listed AS (SELECT tile, CASE WHEN path % 9 = 0 THEN md5('x') ELSE sha END AS sha FROM s WHERE n <> 5 UNION ALL SELECT 'zzzz', md5('z')), held AS (SELECT tile, sha FROM s WHERE n <> 11)
SELECT coalesce(a.tile, b.tile) AS tile, CASE WHEN b.tile IS NULL THEN 'missing' WHEN a.tile IS NULL THEN 'not_listed' WHEN a.sha <> b.sha THEN 'mismatch' ELSE 'available' END AS status FROM listed a FULL JOIN held b ON a.tile = b.tile""")
def source_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files listed in a manifest against files that are there: available, missing, mismatch by digest, or not listed."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("tile"), F.md5("s_name").alias("sha"))
    listed = s.where("n <> 5").select("tile", F.when(F.col("k") % 9 == 0, F.md5(F.lit("x"))).otherwise(F.col("sha")).alias("want"))
    listed = listed.unionByName(s.limit(1).select(F.lit("zzzz").alias("tile"), F.md5(F.lit("z")).alias("want")))
    return inventory(listed, s.where("n <> 11").select("tile", F.col("sha").alias("have")))


def inventory(listed: DataFrame, held: DataFrame) -> DataFrame:
    """(tile, status) of listed(tile, want) and held(tile, have)."""
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "not_listed").when(F.col("want") != F.col("have"), "mismatch").otherwise("available")
    return listed.join(held, "tile", "full").select("tile", status.alias("status"))
