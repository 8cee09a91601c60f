"""Street and place tags, as expressions over a map<string,string> of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of the source's street model, as they must be to give the same classes.
CYCLE_HIGHWAYS = ("cycleway", "path", "footway", "pedestrian", "steps", "track", "living_street", "residential", "service", "unclassified", "tertiary", "tertiary_link", "secondary",
                  "secondary_link", "primary", "primary_link", "trunk", "trunk_link")
BICYCLE_YES = ("yes", "designated", "permissive", "destination")
BICYCLE_NO = ("no", "private", "use_sidepath")
ROAD_CLASSES = {
    "motorway": ("trunk", "trunk_link"),
    "arterial": ("primary", "primary_link", "secondary", "secondary_link"),
    "collector": ("tertiary", "tertiary_link", "unclassified"),
    "service": ("service",),
    "path": ("cycleway", "path", "footway", "pedestrian", "steps", "track"),
}
AMENITIES = {"health": ("pharmacy", "doctors", "clinic", "hospital", "dentist"), "civic": ("library", "community_centre", "townhall", "post_office"), "services": ("bank",), "grocery": ("marketplace",)}
GROCERY_SHOPS = ("supermarket", "convenience", "greengrocer", "bakery")
LEISURE = ("fitness_centre", "sports_centre", "park", "playground", "swimming_pool")
WORK_LANDUSE = ("commercial", "industrial", "institutional", "retail")
WORK_BUILDINGS = ("civic", "college", "commercial", "hospital", "industrial", "office", "retail", "school")
#: Imputed speed, lanes and daily traffic of a class without the stress of a surveyed way.
FALLBACK = {"primary": (60, 4, 15000), "secondary": (60, 4, 15000), "tertiary": (50, 2, 7000), "unclassified": (50, 2, 7000), "residential": (40, 2, 3000), "service": (30, 1, 1000), "unknown": (40, 2, 3000)}
QUIET_WAYS = ("cycleway", "footway", "path", "pedestrian", "steps", "track")
#: Floors where a building says nothing of them, and words in names that say how much of it draws people.
FLOORS = {"education": 3, "commercial": 3, "residential": 2, "medical": 3, "civic": 2, "industrial": 1, "outbuilding": 1, "service": 1}
UNUSED_WORDS = ("underpass", "overpass", "bridge", "car park", "carpark", "parking", "substation", "plant room")
HALF_USED_WORDS = ("press", "house", "annex", "workshop", "test hall", "structures", "building 9", "ray meyer", "carlton pines", "geothermal", "french")
SPORT_WORDS = ("hiwa", "recreation", "sport")


def _low(tags: Column, key: str) -> Column:
    return F.lower(F.coalesce(tags[key], F.lit("")))


def _cycleways(tags: Column) -> Column:
    """Values of all tags whose key begins with cycleway, in lower case."""
    return F.transform(F.map_values(F.map_filter(tags, lambda k, v: k.startswith("cycleway") & v.isNotNull())), F.lower)


def layer(tags: Column) -> Column:
    raw = tags["layer"].try_cast("double").cast("int")
    on = lambda key: F.coalesce(tags[key] != "no", F.lit(False))
    return F.coalesce(raw, F.when(on("bridge"), 1).when(on("tunnel"), -1).otherwise(0))


def cycle_access(tags: Column) -> Column:
    """Whether the public may ride there: a known kind of way, no ban for bicycles, and a word for them where the way or its access would shut them out."""
    highway, bicycle = F.coalesce(tags["highway"], F.lit("")), _low(tags, "bicycle")
    shut = highway.isin("footway", "pedestrian", "steps") | _low(tags, "access").isin("no", "private")
    return highway.isin(*CYCLE_HIGHWAYS) & ~bicycle.isin(*BICYCLE_NO) & (bicycle.isin(*BICYCLE_YES) | ~shut)


def cycle_direction(tags: Column) -> Column:
    """both, forward or reverse: rules for bicycles before those for all, contraflow lanes in between."""
    own, all_ = F.lower(F.coalesce(tags["oneway:bicycle"], tags["bicycle:oneway"], F.lit(""))), _low(tags, "oneway")
    contraflow = F.exists(_cycleways(tags), lambda v: v.startswith("opposite"))
    return (
        F.when(own.isin("no", "0", "false"), "both").when(own.isin("-1", "reverse"), "reverse").when(own.isin("yes", "1", "true"), "forward").when(contraflow, "both")
        .when(all_.isin("-1", "reverse"), "reverse").when(all_.isin("yes", "1", "true") | F.coalesce(tags["junction"] == "roundabout", F.lit(False)), "forward").otherwise("both")
    )


def road_class(tags: Column) -> Column:
    found = F.lit("local")
    for name, highways in ROAD_CLASSES.items():
        found = F.when(F.coalesce(tags["highway"], F.lit("")).isin(*highways), name).otherwise(found)
    return found


def facility(tags: Column) -> Column:
    highway, ways = F.coalesce(tags["highway"], F.lit("")), F.array_join(_cycleways(tags), " ")
    shared = highway.isin("cycleway", "path") & F.coalesce(tags["bicycle"].isin(*BICYCLE_YES), F.lit(False))
    parted = F.coalesce(tags["separation"].isin("kerb", "bollard", "barrier"), F.lit(False))
    quiet = highway.isin("living_street", "cycleway") | F.coalesce(tags["cyclestreet"] == "yes", F.lit(False))
    return F.when(shared, "shared").when(ways.contains("track") | parted, "protected").when(ways.contains("lane"), "painted").when(quiet, "quiet_street").otherwise("mixed_traffic")


def number(tag: Column) -> Column:
    """The first of values parted by semicolons, digits and points only; miles an hour become kilometres."""
    token = F.lower(F.trim(F.split(tag, ";")[0]))
    return F.regexp_replace(token, "[^0-9.]", "").try_cast("double") * F.when(token.contains("mph"), 1.609344).otherwise(1.0)


def destination(tags: Column) -> Column:
    """struct(category, roles) of a place that draws people, null for others."""
    both, work = F.array(F.lit("everyday"), F.lit("employment_proxy")), F.array(F.lit("employment_proxy"))
    amenity, shop, leisure = (_low(tags, k) for k in ("amenity", "shop", "leisure"))
    found = lambda category, roles: F.struct(F.lit(category).alias("category"), roles.alias("roles"))
    some = lambda key: F.length(F.coalesce(tags[key], F.lit(""))) > 0
    works = some("office") | some("industrial") | some("craft") | _low(tags, "landuse").isin(*WORK_LANDUSE) | _low(tags, "building").isin(*WORK_BUILDINGS)
    out = F.when(works, found("employment", work))
    out = F.when(leisure.isin(*LEISURE), found("recreation", both)).otherwise(out)
    out = F.when((shop != "") & ~shop.isin("vacant", "no"), found("retail", both)).otherwise(out)
    out = F.when(shop.isin(*GROCERY_SHOPS), found("grocery", both)).otherwise(out)
    for category, amenities in AMENITIES.items():
        out = F.when(amenity.isin(*amenities), found(category, both)).otherwise(out)
    return out


def stated_facility(*texts: Column) -> Column:
    """The facility that free texts of an inventory name; texts are read together, null is empty."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.when(text.rlike("protected|separated|buffered"), "protected").when(text.rlike("shared path|off-road|off road"), "shared").when(text.rlike("paint|cycle lane|shoulder"), "painted").otherwise("mixed_traffic")


def fallback_stress(way_class: Column, speed: Column) -> Column:
    """Stress of a way by class and posted speed (null: the class's)."""
    out = F.lit(2)
    for name, (imputed, lanes, traffic) in FALLBACK.items():
        v = F.coalesce(speed, F.lit(imputed))
        level = F.lit(4)
        for top, (most_v, most_lanes, most_traffic) in ((3, (50, 3, 12000)), (2, (40, 2, 4000)), (1, (30, 2, 2000))):
            if lanes <= most_lanes and traffic <= most_traffic:
                level = F.when(v <= most_v, top).otherwise(level)
        out = F.when(way_class == name, level).otherwise(out)
    out = F.when(way_class == "living_street", F.when(F.coalesce(speed, F.lit(30)) <= 30, 1).otherwise(2)).otherwise(out)
    return F.when(way_class.isin(*QUIET_WAYS), 1).when(way_class.isin("trunk", "motorway"), 4).otherwise(out)


def floors(observed: Column, height: Column, scanned: Column, subtype: Column) -> Column:
    """struct(floors, source): observed, from the height (3.5 m a floor), from a scanned height of 2.5 m or more (3.6 m), or usual for the subtype; at least 1."""
    usual = F.lit(2)
    for name, n in FLOORS.items():
        usual = F.when(subtype == name, n).otherwise(usual)
    scan = F.when(scanned >= 2.5, F.rint(scanned / 3.6))
    source = F.when(observed.isNotNull(), "observed").when(height.isNotNull(), "from_height").when(scan.isNotNull(), "from_scan").otherwise("default_by_subtype")
    return F.struct(F.greatest(F.coalesce(observed.cast("double"), F.rint(height / 3.5), scan, usual.cast("double")), F.lit(1.0)).alias("floors"), source.alias("source"))


def use_factor(name: Column, kind: Column) -> Column:
    """How much of a building's floor area draws people, from its name and class."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda words: low.rlike("|".join(words))
    return F.when(F.coalesce(kind == "dormitory", F.lit(False)) | has(UNUSED_WORDS), 0.0).when(has(HALF_USED_WORDS), 0.7).when(has(SPORT_WORDS), 0.8).otherwise(1.0)


def relative_direction(direction: Column, reversed_: Column) -> Column:
    """A street's direction as seen along a way that takes it in reverse."""
    return F.when(~reversed_ | ~direction.isin("forward", "reverse"), direction).when(direction == "forward", "reverse").otherwise("forward")


#: Fixed value: a name with a note in brackets, "... (what - number street) rest".
STREET_NOTE = r"^[^()]*\(\s*([^()\-\x{2013}]+?)\s*[-\x{2013}]\s*(?:[0-9]+[A-Za-z]?\s+)?([^()]+?)\s*\)\s*(.*)$"


def street_name(name: Column) -> Column:
    """"Library ( service lane - 26 Princes Street )" becomes "Princes Street service lane"; other names stay."""
    return F.rtrim(F.regexp_replace(name, STREET_NOTE, "$2 $1 $3"))
