"""Access rules of street segments, as expressions over an array of rules.

A rule is struct<kind, heading, modes array, users array, recognized array, during, vehicle boolean, from_ double, to_ double>; kind is allowed, denied or designated, heading forward, backward or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = "array<struct<kind:string,heading:string,modes:array<string>,users:array<string>,recognized:array<string>,during:string,vehicle:boolean,from_:double,to_:double>>"


def _some(x: Column) -> Column:
    return F.coalesce(F.size(x) > 0, F.lit(False))


def binds(rule: Column, mode: str, heading: Column | None) -> Column:
    """Whether a rule binds the public on foot or by bicycle: no time windows, vehicle sizes or groups of users; headings bind riders of that heading only; a
    rule that names modes must name this one ("vehicle" is a bicycle too)."""
    free = rule["during"].isNull() & ~F.coalesce(rule["vehicle"], F.lit(False)) & ~_some(rule["users"]) & ~_some(rule["recognized"])
    along = rule["heading"].isNull() if mode == "foot" else rule["heading"].isNull() | F.coalesce(rule["heading"] == heading, F.lit(False))
    names = F.arrays_overlap(rule["modes"], F.array(*map(F.lit, ("foot",) if mode == "foot" else ("bicycle", "vehicle"))))
    return free & along & (~_some(rule["modes"]) | F.coalesce(names, F.lit(False)))


def open_to(rules: Column, mode: str, heading: Column | None, default: Column) -> Column:
    """Whether a way is open: of the rules that bind, the most specific decides (a heading counts 2, named modes 1), of equals the later one; without any, the class's default."""
    ranked = F.transform(rules, lambda r, i: F.struct(F.when(r["heading"].isNotNull(), 2).otherwise(0) + F.when(_some(r["modes"]), 1).otherwise(0), i, r["kind"].alias("kind"), binds(r, mode, heading).alias("binds")))
    best = F.array_max(F.filter(ranked, lambda r: r["binds"]))
    return F.when(best.isNull(), default).otherwise(F.coalesce(best["kind"] != "denied", F.lit(True)))


def rules_between(rules: Column, start: Column, end: Column) -> Column:
    """The rules that cover the stretch from one share of the segment to another; a rule for a part must overlap it by more than 1e-9."""
    return F.filter(rules, lambda r: r["from_"].isNull() | (F.greatest(start, r["from_"]) < F.least(end, r["to_"]) - 1e-9))
