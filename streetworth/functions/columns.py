"""Column expressions of the domain: stress, comfort, propensity, response to cost, censored counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed (km/h), lanes and daily traffic assumed by road class where they are not known.
ROAD_DEFAULTS = {"motorway": (100, 4, 30000), "arterial": (60, 4, 15000), "collector": (50, 2, 7000), "local": (40, 2, 3000), "service": (30, 1, 1000), "path": (20, 1, 0)}
#: Highest speed, lanes and traffic of each stress level, by facility.
STRESS_LIMITS = {"painted": ((2, 40, 2, 6000), (3, 50, 3, 15000)), "mixed_traffic": ((1, 30, 2, 2000), (2, 40, 2, 4000), (3, 50, 3, 12000))}
#: Speed and traffic of a quiet street of level 1, speed of level 2.
QUIET_LIMITS = ((30, 2000), (40, None))
#: Metres of a walk that count whole and not at all; kilometres up to which distance does not matter and over which it decays after.
WALK_M, DECAY_KM = (50, 250), (12, 5)
#: Cost multiplier of stress levels 1 to 4.
STRESS_COST = (1.0, 1.2, 1.6, 2.2)
#: Alpha, distance, root of distance, squared distance, gradient, gradient's centre, distance * gradient, root * gradient.
PROPENSITY = {
    "government": (-4.018, -0.6369, 1.988, 0.008775, -0.2555, 0.78, 0.02006, -0.1234),
    "go_dutch": (-4.018 + 2.550, -0.6369 - 0.08036, 1.988, 0.008775, -0.2555, 0.78, 0.02006, -0.1234),
    "ebike": (-4.018 + 2.550, -0.6369 - 0.08036 + 0.05509, 1.988, 0.008775 - 0.000295, -0.2555 + 0.1812, 0.78, 0.02006, -0.1234),
}


def assumed(value: Column, road_class: Column, which: int) -> Column:
    """value, or the default of the road class."""
    default = F.lit(None)
    for name, known in ROAD_DEFAULTS.items():
        default = F.when(road_class == name, known[which]).otherwise(default)
    return F.coalesce(value, default)


def stress_level(road_class: Column, facility: Column, speed: Column, lanes: Column, traffic: Column) -> Column:
    """Level of traffic stress, 1 to 4."""

    def limits(name: str) -> Column:
        level = F.lit(4)
        for n, s, k, t in reversed(STRESS_LIMITS[name]):
            level = F.when((speed <= s) & (lanes <= k) & (traffic <= t), n).otherwise(level)
        return level

    quiet = F.when((speed <= QUIET_LIMITS[0][0]) & (traffic <= QUIET_LIMITS[0][1]), 1).when(speed <= QUIET_LIMITS[1][0], 2).otherwise(3)
    return F.when(road_class == "motorway", 4).when(facility.isin("protected", "shared"), 1).when(facility == "quiet_street", quiet).when(facility == "painted", limits("painted")).otherwise(limits("mixed_traffic"))


def comfort_multiplier(stress: Column, gradient: Column, tunnel: Column, bridge: Column) -> Column:
    """Cost for each metre: stress, slope (uphill four times, downhill half), tunnels and bridges."""
    slope = 1 + 4 * F.greatest(F.lit(0.0), gradient) + 0.5 * F.greatest(F.lit(0.0), -gradient)
    return F.element_at(F.array(*map(F.lit, STRESS_COST)), stress.cast("int")) * slope * F.when(tunnel, 1.25).otherwise(1.0) * F.when(bridge, 1.05).otherwise(1.0)


def propensity(scenario: str, distance_km: Column, gradient: Column) -> Column:
    a, d1, d_root, d2, g1, centre, dg, root_g = PROPENSITY[scenario]
    d = F.least(distance_km, F.lit(30.0))
    g = gradient - centre
    eta = a + d1 * d + d_root * F.sqrt(d) + d2 * d * d + g1 * g + dg * d * g + root_g * F.sqrt(d) * g
    return 1 / (1 + F.exp(-eta))


def odds_response(eligible: Column, base: Column, cost_before: Column, cost_after: Column, elasticity: float) -> Column:
    """Additional users when cost falls: the odds of use grow by the elasticity times the log ratio of costs; never more than those not yet using."""
    some = F.greatest(eligible, F.lit(1e-9))
    share = F.greatest(F.lit(1e-5), F.least(base / some, F.lit(1 - 1e-5)))
    p = 1 / (1 + F.exp(-(F.log(share / (1 - share)) + elasticity * F.log(cost_before / cost_after))))
    more = F.greatest(F.lit(0.0), F.least(eligible * (p - base / some), eligible - base))
    return F.when((eligible <= 0) | (cost_after >= cost_before), 0.0).otherwise(more)


def censored_interval(count: Column, strategy: str = "midpoint", suppressed: int = -999) -> Column:
    """struct<lower, point, upper> of a rounded count (two either side) or of a suppressed one (0 to 5)."""
    point = F.lit(2.5 if strategy == "midpoint" else 0.0)
    known = F.struct(F.greatest(F.lit(0.0), count - 2.0).alias("lower"), count.cast("double").alias("point"), (count + 2.0).alias("upper"))
    return F.when(count == suppressed, F.struct(F.lit(0.0).alias("lower"), point.alias("point"), F.lit(5.0).alias("upper"))).otherwise(known)


def walk_credit(distance_m: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least((WALK_M[1] - distance_m) / (WALK_M[1] - WALK_M[0]), F.lit(1.0)))


def distance_decay(distance_km: Column) -> Column:
    """1 up to 12 km, then exponential over 5 km."""
    return F.when(distance_km <= DECAY_KM[0], 1.0).otherwise(F.exp(-(distance_km - DECAY_KM[0]) / DECAY_KM[1]))


def inverse_uniform(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def inverse_loguniform(u: Column, low: float, high: float) -> Column:
    return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))


def inverse_triangular(u: Column, low: float, mode: float, high: float) -> Column:
    left = low + F.sqrt(u * (high - low) * (mode - low))
    return F.when(u < (mode - low) / (high - low), left).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def bearing_difference(a: Column, b: Column) -> Column:
    """Degrees between two undirected bearings, 0 to 90."""
    apart = F.abs(F.pmod(a - b + 180, F.lit(360)) - 180)
    return F.least(apart, 180 - apart)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the great circle on a sphere of 6371008.8 m."""
    h = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def speed_kph(tag: Column) -> Column:
    """Number of a speed tag: the first of several values, miles turned into kilometres; null where there is none."""
    first = F.trim(F.element_at(F.split(tag, ";"), 1))
    value = F.try_to_number(F.nullif(F.regexp_extract(first, r"^([0-9]+)", 1), F.lit("")), F.lit("99999")).cast("double")
    return F.when(F.lower(first).contains("mph"), value * 1.609344).otherwise(value)


def csv_guard(text: Column) -> Column:
    """A leading apostrophe before text that a spreadsheet would take for a formula."""
    return F.when(text.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), text)).otherwise(text)
