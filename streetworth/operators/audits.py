"""Audits of stored ledgers: every rule counts its violations, nothing raises, so that one pass says all that is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule with the number of rows that break it (a null result does not), and one named `rows` with all rows: one aggregation, then unpivoted."""
    sums = rows.agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()))
    return sums.select(F.explode(F.map_from_arrays(F.array(F.lit("rows"), *map(F.lit, rules)), F.array("rows", *rules))).alias("rule", "count"))


def od_ledger(ledger: DataFrame) -> DataFrame:
    """ledger(od, stratum, stratum_sample, selected, weight, status, reason, paths, probabilities): ids, statuses, path lists, probabilities that sum to 1 within 1e-12, declared sample sizes."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p)
    rules = {
        "list_lengths_differ": F.coalesce(F.size("paths"), F.lit(0)) != F.coalesce(F.size("probabilities"), F.lit(0)),
        "selected_without_weight": F.col("selected") & ~(F.col("weight") > 0),
        "selected_with_unknown_status": F.col("selected") & ~F.col("status").isin("assigned", "unassigned"),
        "unselected_with_other_status": ~F.col("selected") & (F.col("status") != "not_selected"),
        "unselected_with_paths_or_weight": ~F.col("selected") & (some("paths") | (F.col("weight") != 0)),
        "assigned_without_paths": (F.col("status") == "assigned") & ~some("paths"),
        "assigned_with_reason": (F.col("status") == "assigned") & F.col("reason").isNotNull(),
        "probabilities_not_one": (F.col("status") == "assigned") & some("probabilities") & (F.abs(total - 1) > 1e-12),
        "failed_without_reason": (F.col("status") == "unassigned") & F.col("reason").isNull(),
        "failed_with_paths": (F.col("status") == "unassigned") & some("paths"),
    }
    ids = ledger.groupBy("od").agg(F.count("*").alias("n"))
    strata = ledger.groupBy("stratum").agg(F.count_if("selected").alias("n"), F.min("stratum_sample").alias("least"), F.max("stratum_sample").alias("most"))
    wrong = counted(strata, {"stratum_sample_differs": (F.col("n") != F.col("least")) | (F.col("least") != F.col("most"))}).where("rule <> 'rows'")
    return counted(ledger, rules).unionByName(counted(ids, {"repeated_od": F.col("n") > 1}).where("rule <> 'rows'")).unionByName(wrong)


def scenario_ledger(ledger: DataFrame, units: DataFrame, scenarios: int = 5) -> DataFrame:
    """ledger(scenario, od, users) against units(od, eligible, observed, status): every unit once in each scenario, observed <= users <= eligible, users only where assigned."""
    keys = ledger.groupBy("od", "scenario").agg(F.count("*").alias("n")).groupBy("od").agg(F.count("*").alias("kinds"), F.max("n").alias("most"))
    met = units.select("od", F.lit(True).alias("known")).join(keys, "od", "full")
    sets = counted(met, {"unit_lacks_scenarios": F.col("known") & (F.coalesce("kinds", F.lit(0)) < scenarios), "repeated_rows": F.col("most") > 1, "unknown_units": F.col("known").isNull()}).where("rule <> 'rows'")
    rows = ledger.join(units, "od")
    ok = F.col("status") == "assigned"
    values = {"below_observed": ok & (F.col("users") < F.col("observed") - 1e-9), "above_eligible": ok & (F.col("users") > F.col("eligible") + 1e-9), "assigned_without_users": ok & F.col("users").isNull(), "users_without_route": ~ok & F.col("users").isNotNull()}
    return counted(rows, values).unionByName(sets)


def mass(parts: DataFrame, cells: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """parts(cell, mass) against cells(cell, mass): cells whose parts do not sum to them, cells without parts, parts of no cell."""
    met = cells.select("cell", F.col("mass").alias("_m")).join(parts.groupBy("cell").agg(F.sum("mass").alias("_s")), "cell", "full")
    return counted(met, {"mass_differs": F.abs(F.col("_m") - F.col("_s")) > tolerance, "cell_without_parts": F.col("_s").isNull(), "parts_without_cell": F.col("_m").isNull()})


def exactly_once(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, times) of what is not in rows exactly once, of all that is expected or there."""
    times = rows.groupBy(*keys).agg(F.count("*").alias("times"))
    return expected.select(*keys, F.lit(True).alias("_e")).distinct().join(times, keys, "full").where("_e is null or times is null or times <> 1").select(*keys, F.coalesce("times", F.lit(0)).alias("times"), F.col("_e").isNotNull().alias("expected"))


def rights(decisions: DataFrame, layers: DataFrame, sources: DataFrame) -> DataFrame:
    """decisions(source, redistribution, decision), layers(layer, source), sources(source, redistribution): (source, issue), a row for each rule of publication that a source breaks."""
    used = layers.groupBy("source").agg(F.count("*").alias("uses"))
    d = decisions.groupBy("source").agg(F.count("*").alias("n"), F.max("decision").alias("decision"), F.max("redistribution").alias("said"))
    met = sources.withColumnRenamed("redistribution", "known").join(d, "source", "full").join(used, "source", "full")
    out = F.col("decision") == "exclude"
    issues = F.array_compact(F.array(
        F.when(F.col("n") > 1, "repeated_decision"), F.when(F.col("known").isNotNull() & F.col("n").isNull(), "no_decision"), F.when(F.col("n").isNotNull() & F.col("known").isNull(), "unregistered_source"),
        F.when(F.col("said") != F.col("known"), "redistribution_differs"), F.when(F.col("uses").isNotNull() & F.col("n").isNull(), "used_without_decision"), F.when(out & F.col("uses").isNotNull(), "excluded_but_used"),
        F.when(~out & F.col("said").isin("unknown", "restricted"), "must_be_excluded"), F.when(~out & F.col("uses").isNull(), "included_but_not_used"),
    ))
    return met.select("source", F.explode(issues).alias("issue"))


def order_matches(steps: DataFrame, declared: DataFrame) -> DataFrame:
    """steps(key, place, id) against declared(key, ids): match, order_differs, set_differs, missing or undeclared."""
    own = steps.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("own"))
    same = F.array_sort("own") == F.array_sort("ids")
    status = F.when(F.col("own").isNull(), "missing").when(F.col("ids").isNull(), "undeclared").when(F.col("own") == F.col("ids"), "match").when(same, "order_differs").otherwise("set_differs")
    return declared.join(own, "key", "full").select("key", status.alias("status"))
