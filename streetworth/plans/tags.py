"""Streets, places and buildings with tags, derived from parts and suppliers, and the queries that classify them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.functions import tags as T
from streetworth.plans.fixtures import table
from streetworth.registry import query

#: Tag: (modulus of the key, its values from remainder 0 on; null beyond them).
WAY_TAGS = {
    "highway": (22, ["cycleway", "path", "footway", "pedestrian", "steps", "track", "living_street", "residential", "service", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "trunk", "trunk_link", "motorway", "construction"]),
    "bicycle": (7, [None, "yes", "no", "designated", "Private", "use_sidepath", "permissive"]),
    "access": (5, [None, "no", "private", None, "yes"]),
    "oneway": (6, [None, "yes", "-1", "no", "True"]),
    "oneway:bicycle": (11, [None, "no", "yes", "-1"]),
    "cycleway": (9, [None, "lane", "track", "opposite_lane", "shared_lane"]),
    "cycleway:left": (13, [None, "Track", "opposite"]),
    "junction": (17, ["roundabout"]),
    "separation": (19, ["kerb", "none"]),
    "cyclestreet": (23, ["yes"]),
    "layer": (8, [None, "1", "-1", "x", "1.5"]),
    "bridge": (10, ["yes", "no"]),
    "tunnel": (12, ["yes", "no"]),
    "maxspeed": (8, ["50", "30 mph", "60;80", None, "walk", " 40 km/h", "70.5"]),
    "lanes": (5, ["2", "3;2", None, "1.5"]),
}
PLACE_TAGS = {
    "amenity": (9, ["pharmacy", "library", None, "bank", "marketplace", "parking", "Hospital"]),
    "shop": (7, [None, "supermarket", "vacant", "clothes", None, "Bakery"]),
    "leisure": (5, [None, "park", "garden"]),
    "office": (11, ["company", ""]),
    "craft": (13, ["brewery"]),
    "landuse": (4, [None, "retail", "forest"]),
    "building": (6, ["school", "house", "Office"]),
}


def tagged(rows: DataFrame, key: str, tags: dict) -> DataFrame:
    """rows(id, tags): only the tags that a row has."""
    k = F.col(key)
    pairs = [x for name, (n, values) in tags.items() for x in (F.lit(name), F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % n).cast("int")))]
    return rows.select(k.alias("id"), F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("tags"))


def _sql(name: str, key: str, tags: dict) -> str:
    """The same columns for DuckDB; a tag that is not there is null."""
    listed = lambda values: ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"tagged AS (SELECT {key} AS id, " + ", ".join(f"""([{listed(v)}])[{key} % {n} + 1] AS "{tag}\"""" for tag, (n, v) in tags.items()) + f" FROM {name})"


_WAYS, _PLACES = _sql("part", "p_partkey", WAY_TAGS), _sql("customer", "c_custkey", PLACE_TAGS)


def ways(spark: SparkSession, d: str) -> DataFrame:
    return tagged(table(spark, d, "part"), "p_partkey", WAY_TAGS)


_NUMBER = """CASE WHEN contains(lower({0}), 'mph') AND contains(lower(split_part({0}, ';', 1)), 'mph') THEN 1.609344e0 ELSE 1e0 END * TRY_CAST(regexp_replace(split_part({0}, ';', 1), '[^0-9.]', '', 'g') AS DOUBLE)"""


@query(f"""WITH {_WAYS}, low AS (SELECT *, lower(coalesce(bicycle, '')) AS b, lower(coalesce(access, '')) AS a, coalesce(highway, '') AS h, lower(coalesce(oneway, '')) AS o, coalesce("oneway:bicycle", '') AS ob,
  coalesce(lower(cycleway), '') AS c1, coalesce(lower("cycleway:left"), '') AS c2 FROM tagged)
SELECT id AS way,
h IN ('cycleway','path','footway','pedestrian','steps','track','living_street','residential','service','unclassified','tertiary','tertiary_link','secondary','secondary_link','primary','primary_link','trunk','trunk_link')
  AND b NOT IN ('no','private','use_sidepath') AND (b IN ('yes','designated','permissive','destination') OR (h NOT IN ('footway','pedestrian','steps') AND a NOT IN ('no','private'))) AS cyclable,
CASE WHEN ob = 'no' THEN 'both' WHEN ob = '-1' THEN 'reverse' WHEN ob = 'yes' THEN 'forward' WHEN starts_with(c1, 'opposite') OR starts_with(c2, 'opposite') THEN 'both'
  WHEN o IN ('-1','reverse') THEN 'reverse' WHEN o IN ('yes','1','true') OR junction IS NOT DISTINCT FROM 'roundabout' THEN 'forward' ELSE 'both' END AS direction,
CASE WHEN h IN ('trunk','trunk_link') THEN 'motorway' WHEN h IN ('primary','primary_link','secondary','secondary_link') THEN 'arterial' WHEN h IN ('tertiary','tertiary_link','unclassified') THEN 'collector'
  WHEN h = 'service' THEN 'service' WHEN h IN ('cycleway','path','footway','pedestrian','steps','track') THEN 'path' ELSE 'local' END AS road_class,
CASE WHEN h IN ('cycleway','path') AND coalesce(bicycle, '') IN ('yes','designated','permissive','destination') THEN 'shared' WHEN contains(c1 || ' ' || c2, 'track') OR separation IS NOT DISTINCT FROM 'kerb' THEN 'protected'
  WHEN contains(c1 || ' ' || c2, 'lane') THEN 'painted' WHEN h IN ('living_street','cycleway') OR cyclestreet IS NOT DISTINCT FROM 'yes' THEN 'quiet_street' ELSE 'mixed_traffic' END AS facility,
CAST(coalesce(trunc(TRY_CAST(layer AS DOUBLE)), CASE WHEN bridge = 'yes' THEN 1 WHEN tunnel = 'yes' THEN -1 ELSE 0 END) AS INTEGER) AS layer,
round({_NUMBER.format("maxspeed")}, 6) AS speed, CAST(round_even({_NUMBER.format("lanes")}, 0) AS INTEGER) AS lanes FROM low""")
def way_classes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tags")
    return ways(spark, d).select(
        F.col("id").alias("way"), T.cycle_access(t).alias("cyclable"), T.cycle_direction(t).alias("direction"), T.road_class(t).alias("road_class"), T.facility(t).alias("facility"),
        T.layer(t).alias("layer"), F.round(T.number(t["maxspeed"]), 6).alias("speed"), F.rint(T.number(t["lanes"])).cast("int").alias("lanes"),
    )


_DESTINATIONS = """low AS (SELECT *, lower(coalesce(amenity, '')) AS a, lower(coalesce(shop, '')) AS s, lower(coalesce(leisure, '')) AS l FROM tagged),
placed AS (SELECT id AS place, CASE WHEN a IN ('pharmacy','doctors','clinic','hospital','dentist') THEN 'health' WHEN a IN ('library','community_centre','townhall','post_office') THEN 'civic' WHEN a = 'bank' THEN 'services'
  WHEN a = 'marketplace' THEN 'grocery' WHEN s IN ('supermarket','convenience','greengrocer','bakery') THEN 'grocery' WHEN s NOT IN ('', 'vacant', 'no') THEN 'retail'
  WHEN l IN ('fitness_centre','sports_centre','park','playground','swimming_pool') THEN 'recreation' WHEN coalesce(office, '') <> '' OR craft IS NOT NULL
  OR lower(coalesce(landuse, '')) IN ('commercial','industrial','institutional','retail') OR lower(coalesce(building, '')) IN ('civic','college','commercial','hospital','industrial','office','retail','school') THEN 'employment' END AS category FROM low)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    found = tagged(table(spark, d, "customer"), "c_custkey", PLACE_TAGS).withColumn("found", T.destination(F.col("tags")))
    return found.where("found is not null").select(F.col("id").alias("place"), "found.*")


@query(f"WITH {_PLACES}, {_DESTINATIONS} SELECT place, category, CASE category WHEN 'employment' THEN 'employment_proxy' ELSE 'everyday,employment_proxy' END AS roles FROM placed WHERE category IS NOT NULL")
def destination_places(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("place", "category", F.array_join("roles", ",").alias("roles"))


@query(f"""WITH {_PLACES}, {_DESTINATIONS}, jobs AS (SELECT c_nationkey AS zone, sum(abs(c_acctbal)) AS jobs FROM customer GROUP BY 1),
work AS (SELECT place, c_nationkey AS zone, count(*) OVER (PARTITION BY c_nationkey) AS n FROM placed JOIN customer ON place = c_custkey WHERE category = 'employment')
SELECT zone, place, round(jobs / n, 6) AS weight, CASE WHEN place IS NULL THEN 'no_place_of_work' ELSE 'supported' END AS status FROM jobs LEFT JOIN work USING (zone)""")
def employment_supports(spark: SparkSession, d: str) -> DataFrame:
    """Each zone's jobs in equal parts over its places of work; a zone without one stays, with the reason."""
    customers = table(spark, d, "customer")
    jobs = customers.groupBy(F.col("c_nationkey").alias("zone")).agg(F.sum(F.abs("c_acctbal")).alias("jobs"))
    work = places(spark, d).where("category = 'employment'").join(customers.select(F.col("c_custkey").alias("place"), F.col("c_nationkey").alias("zone")), "place")
    counts = jobs.join(work.groupBy("zone").agg(F.count("*").alias("n")), "zone", "left")
    status = F.when(F.col("place").isNull(), "no_place_of_work").otherwise("supported")
    return counts.join(work.select("zone", "place"), "zone", "left").select("zone", "place", F.round(F.col("jobs") / F.col("n"), 6).alias("weight"), status.alias("status"))


_TEXTS = ["Protected cycleway", "Shared Path", "painted lane", "Off-Road trail", "Cycle lane, buffered", "road", "Shoulder", "separated"]


@query(f"""WITH named AS (SELECT p_partkey AS feature, ([{', '.join(repr(t) for t in _TEXTS)}, NULL])[p_partkey % 9 + 1] AS type, p_type FROM part), texts AS (SELECT feature, lower(concat_ws(' ', type, p_type)) AS t FROM named)
SELECT feature, CASE WHEN regexp_matches(t, 'protected|separated|buffered') THEN 'protected' WHEN regexp_matches(t, 'shared path|off-road|off road') THEN 'shared' WHEN regexp_matches(t, 'paint|cycle lane|shoulder') THEN 'painted' ELSE 'mixed_traffic' END AS facility FROM texts""")
def stated_facilities(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    stated = F.get(F.array(*map(F.lit, _TEXTS)), (p % 9).cast("int"))
    return table(spark, d, "part").select(p.alias("feature"), T.stated_facility(stated, F.col("p_type")).alias("facility"))


_CLASSES = ["primary", "tertiary", "residential", "service", "unknown", "living_street", "cycleway", "steps", "trunk", "motorway", "other", "unclassified", "secondary"]
_FALLBACK = f"""classed AS (SELECT p_partkey AS way, ([{', '.join(repr(c) for c in _CLASSES)}])[p_partkey % 13 + 1] AS cls, CASE WHEN p_size % 6 > 0 THEN p_size % 6 * 10 + 10 END AS posted FROM part),
imputed AS (SELECT *, CASE WHEN cls IN ('primary','secondary') THEN 60 WHEN cls IN ('tertiary','unclassified') THEN 50 WHEN cls IN ('residential','unknown') THEN 40 WHEN cls = 'service' THEN 30 END AS usual,
  CASE WHEN cls IN ('primary','secondary') THEN 4 WHEN cls = 'service' THEN 1 ELSE 2 END AS lanes, CASE WHEN cls IN ('primary','secondary') THEN 15000 WHEN cls IN ('tertiary','unclassified') THEN 7000 WHEN cls = 'service' THEN 1000 ELSE 3000 END AS t FROM classed),
own AS (SELECT *, CASE WHEN cls IN ('cycleway','steps') THEN 1 WHEN cls IN ('trunk','motorway') THEN 4 WHEN cls = 'living_street' THEN CASE WHEN coalesce(posted, 30) <= 30 THEN 1 ELSE 2 END WHEN usual IS NULL THEN 2
  WHEN coalesce(posted, usual) <= 30 AND lanes <= 2 AND t <= 2000 THEN 1 WHEN coalesce(posted, usual) <= 40 AND lanes <= 2 AND t <= 4000 THEN 2 WHEN coalesce(posted, usual) <= 50 AND lanes <= 3 AND t <= 12000 THEN 3 ELSE 4 END AS lts FROM imputed)"""


def classed_ways(spark: SparkSession, d: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size") % 6
    rows = table(spark, d, "part").select(p.alias("way"), F.get(F.array(*map(F.lit, _CLASSES)), (p % 13).cast("int")).alias("cls"), F.when(size > 0, size * 10 + 10).alias("posted"))
    return rows.withColumn("own_lts", T.fallback_stress(F.col("cls"), F.col("posted")))


@query(f"""WITH {_FALLBACK}, shares AS (SELECT l_partkey AS way, l_linenumber % 4 + 1 AS lts, sum(l_quantity) AS share FROM lineitem GROUP BY 1, 2),
best AS (SELECT way, lts AS surveyed FROM (SELECT *, row_number() OVER (PARTITION BY way ORDER BY share DESC, lts DESC) AS n FROM shares) WHERE n = 1)
SELECT way, cls, CAST(CASE WHEN surveyed IS NOT NULL AND cls NOT IN ('steps', 'other') THEN surveyed ELSE lts END AS INTEGER) AS lts,
CASE WHEN surveyed IS NOT NULL AND cls NOT IN ('steps', 'other') THEN 'surveyed' ELSE 'class_and_speed' END AS source FROM own LEFT JOIN best USING (way)""")
def surveyed_stress(spark: SparkSession, d: str) -> DataFrame:
    """Stress by class and speed, replaced by that of most of a surveyed way's length (of equals the higher) where the class takes part in the survey."""
    shares = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("way"), (F.col("l_linenumber") % 4 + 1).alias("lts")).agg(F.sum("l_quantity").alias("share"))
    best = shares.groupBy("way").agg(F.max_by("lts", F.struct("share", "lts")).alias("surveyed"))
    taken = F.col("surveyed").isNotNull() & ~F.col("cls").isin("steps", "other")
    rows = classed_ways(spark, d).join(best, "way", "left")
    return rows.select("way", "cls", F.when(taken, F.col("surveyed")).otherwise(F.col("own_lts")).cast("int").alias("lts"), F.when(taken, "surveyed").otherwise("class_and_speed").alias("source"))


@query("""WITH b AS (SELECT p_partkey AS building, CASE WHEN p_partkey % 5 = 0 THEN p_size % 9 END AS observed, CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.7e0 END AS height, CASE WHEN p_partkey % 2 = 0 THEN p_size * 0.45e0 END AS scanned,
  (['education','commercial','residential','medical','civic','industrial','outbuilding',NULL])[p_partkey % 8 + 1] AS subtype, p_retailprice AS footprint, p_name FROM part),
f AS (SELECT *, greatest(1e0, coalesce(CAST(observed AS DOUBLE), round_even(height / 3.5e0, 0), CASE WHEN scanned >= 2.5e0 THEN round_even(scanned / 3.6e0, 0) END, CASE WHEN subtype IN ('education','commercial','medical') THEN 3e0 WHEN subtype IN ('industrial','outbuilding') THEN 1e0 ELSE 2e0 END)) AS floors,
  CASE WHEN observed IS NOT NULL THEN 'observed' WHEN height IS NOT NULL THEN 'from_height' WHEN scanned >= 2.5e0 THEN 'from_scan' ELSE 'default_by_subtype' END AS source FROM b),
n AS (SELECT *, lower(concat_ws(' ', (['Sports hall','Old House','Car Park','Hiwa centre','Science block',NULL])[building % 6 + 1], p_name)) AS name FROM f)
SELECT building, floors, source, round(footprint * floors, 4) AS gfa, CASE WHEN building % 17 = 0 THEN 0e0 WHEN regexp_matches(name, 'underpass|overpass|bridge|car park|carpark|parking|substation|plant room') THEN 0e0
  WHEN regexp_matches(name, 'press|house|annex|workshop|test hall|structures|building 9|ray meyer|carlton pines|geothermal|french') THEN 0.7e0 WHEN regexp_matches(name, 'hiwa|recreation|sport') THEN 0.8e0 ELSE 1e0 END AS use_factor FROM n""")
def building_floors(spark: SparkSession, d: str) -> DataFrame:
    """Floors, where they come from, floor area, and how much of it draws people."""
    p, size = F.col("p_partkey"), F.col("p_size")
    subtypes = F.array(*map(F.lit, ("education", "commercial", "residential", "medical", "civic", "industrial", "outbuilding")))
    found = T.floors(F.when(p % 5 == 0, size % 9), F.when(p % 3 == 0, size * 0.7), F.when(p % 2 == 0, size * 0.45), F.get(subtypes, (p % 8).cast("int")))
    name = F.concat_ws(" ", F.get(F.array(*map(F.lit, ("Sports hall", "Old House", "Car Park", "Hiwa centre", "Science block"))), (p % 6).cast("int")), "p_name")
    use = T.use_factor(name, F.when(p % 17 == 0, "dormitory"))
    rows = table(spark, d, "part").select(p.alias("building"), "p_retailprice", found.alias("f"), use.alias("use_factor"))
    return rows.select("building", "f.floors", "f.source", F.round(F.col("p_retailprice") * F.col("f.floors"), 4).alias("gfa"), "use_factor")


@query("""WITH named AS (SELECT s_suppkey AS street, CASE s_suppkey % 3 WHEN 0 THEN 'Library ( service lane - ' || s_suppkey || ' ' || s_name || ' ) north' WHEN 1 THEN s_name || ' (campus path)' ELSE 'Hall (walk - ' || s_name || ')' END AS name FROM supplier)
SELECT street, rtrim(regexp_replace(name, '^[^()]*\\(\\s*([^()\\-]+?)\\s*-\\s*(?:[0-9]+[A-Za-z]?\\s+)?([^()]+?)\\s*\\)\\s*(.*)$', '\\2 \\1 \\3')) AS name FROM named""".replace("\\\\", "\\"))
def street_names(spark: SparkSession, d: str) -> DataFrame:
    s, name = F.col("s_suppkey"), F.col("s_name")
    noted = F.when(s % 3 == 0, F.concat(F.lit("Library ( service lane - "), s.cast("string"), F.lit(" "), name, F.lit(" ) north"))).when(s % 3 == 1, F.concat(name, F.lit(" (campus path)"))).otherwise(F.concat(F.lit("Hall (walk - "), name, F.lit(")")))
    return table(spark, d, "supplier").select(s.alias("street"), T.street_name(noted).alias("name"))


@query(f"""WITH {_WAYS} SELECT id AS way, p_brand AS candidate, CASE WHEN id % 2 = 0 OR direction NOT IN ('forward', 'reverse') THEN direction WHEN direction = 'forward' THEN 'reverse' ELSE 'forward' END AS direction
FROM (SELECT id, CASE WHEN lower(coalesce(oneway, '')) = '-1' THEN 'reverse' WHEN lower(coalesce(oneway, '')) IN ('yes', 'true') THEN 'forward' ELSE 'both' END AS direction FROM tagged) JOIN part ON id = p_partkey""")
def direction_along_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Directions of a candidate's streets as seen along it; every other street is met in reverse."""
    direction = T.cycle_direction(F.map_filter("tags", lambda k, _: k == "oneway"))
    found = ways(spark, d).select(F.col("id").alias("way"), T.relative_direction(direction, F.col("id") % 2 == 1).alias("direction"))
    return found.join(table(spark, d, "part").select(F.col("p_partkey").alias("way"), F.col("p_brand").alias("candidate")), "way").select("way", "candidate", "direction")


def stations(frame: Column) -> Column:
    return ~frame.rlike("Old |Scenic|Siding")


@query("""WITH s AS (SELECT s_suppkey AS station, (['Old ','Scenic ','North ','East ',''])[s_suppkey % 5 + 1] || s_name || CASE WHEN s_suppkey % 7 = 0 THEN ' Siding' ELSE '' END AS name, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 10009 AS DOUBLE) AS y FROM supplier),
areas AS (SELECT n_nationkey AS area, n_nationkey * 397 % 10007 AS ax, n_nationkey * 6007 % 10009 AS ay FROM nation)
SELECT DISTINCT station, name FROM s JOIN areas ON x BETWEEN ax - 800 AND ax + 1300 AND y BETWEEN ay - 800 AND ay + 1300
WHERE NOT regexp_matches(name, 'Old |Scenic|Siding') AND hypot_(greatest(ax - x, 0, x - ax - 500), greatest(ay - y, 0, y - ay - 500)) <= 800""".replace("hypot_(", "sqrt(pow(").replace(", 0, x - ax - 500), greatest", ", 0, x - ax - 500), 2) + pow(greatest").replace("y - ay - 500)) <= 800", "y - ay - 500), 2)) <= 800"))
def named_stations(spark: SparkSession, d: str) -> DataFrame:
    """Named stations within 800 m of a study area (a square of 500 m), without sidings and heritage stops; a few areas, so the join by range is a broadcast."""
    s = F.col("s_suppkey")
    name = F.concat(F.get(F.array(*map(F.lit, ("Old ", "Scenic ", "North ", "East ", ""))), (s % 5).cast("int")), "s_name", F.when(s % 7 == 0, " Siding").otherwise(""))
    found = table(spark, d, "supplier").select(s.alias("station"), name.alias("name"), (s * 7919 % 10007).cast("double").alias("x"), (s * 104729 % 10009).cast("double").alias("y")).where(stations(F.col("name")))
    n = F.col("n_nationkey")
    areas = table(spark, d, "nation").select((n * 397 % 10007).alias("ax"), (n * 6007 % 10009).alias("ay"))
    cells = areas.withColumn("cx", F.explode(F.sequence(F.floor((F.col("ax") - 800) / 2000), F.floor((F.col("ax") + 1300) / 2000)))).withColumn("cy", F.explode(F.sequence(F.floor((F.col("ay") - 800) / 2000), F.floor((F.col("ay") + 1300) / 2000))))
    gap = [F.greatest(F.col(f"a{c}") - F.col(c), F.lit(0), F.col(c) - F.col(f"a{c}") - 500) for c in "xy"]
    near = found.withColumns({"cx": F.floor(F.col("x") / 2000), "cy": F.floor(F.col("y") / 2000)}).join(cells, ["cx", "cy"]).where(F.hypot(*gap) <= 800)
    return near.select("station", "name").distinct()
