"""Search of ways over what may be built: labels with fixed-charge projects, stress limits, turns, detour and time limits, by rounds of joins.

arcs(arc, u, v, length, time, cost, stress, treated, project): an arc above the stress limit may be used if its project lowers it to `treated` within the limit. turns(arc, next, delay, stress,
treated, project, banned) say what a movement adds or forbids. A round extends the labels that the last one found and is a saved table; labels of one journey at one place are
one row's array, so dominance is decided inside a row, by built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetworth.operators.graph import _save, shortest_costs

EPS = 1e-9
INF = float("inf")


def legal_lengths(arcs: DataFrame, ods: DataFrame, turns: DataFrame | None) -> DataFrame:
    """(od, shortest): length of the shortest way on all arcs without a banned turn; no row where there is none. Searched over movements between arcs."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    starts = arcs.select(name("n", "u").alias("u"), name("a", "arc").alias("v"), F.col("length").alias("cost"))
    moves = arcs.select("arc", F.col("v").alias("at")).join(arcs.select(F.col("arc").alias("next"), F.col("u").alias("at"), "length"), "at")
    if turns is not None:
        moves = moves.join(turns.where("banned").select("arc", "next"), ["arc", "next"], "left_anti")
    line = _save(starts.unionByName(moves.select(name("a", "arc").alias("u"), name("a", "next").alias("v"), F.col("length").alias("cost"))))
    far = shortest_costs(line, ods.select(name("n", "origin").alias("source")).distinct(), INF)
    ends = far.join(arcs.select(name("a", "arc").alias("node"), F.col("v").alias("destination")), "node").groupBy("source", "destination").agg(F.min("cost").alias("shortest"))
    return ods.withColumn("source", name("n", "origin")).join(ends, ["source", "destination"]).select("od", "shortest")


def _rests(arcs: DataFrame, ods: DataFrame) -> DataFrame:
    """(destination, node, rest_length, rest_time): least length and least time from a node to each destination, bounds whatever is built."""
    goals = ods.select(F.col("destination").alias("source")).distinct()
    least = lambda c: shortest_costs(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col(c).alias("cost")), goals, INF).toDF("destination", "node", f"rest_{c}")
    return _save(least("length").join(least("time"), ["destination", "node"]))


def _search(arcs: DataFrame, ods: DataFrame, capital: DataFrame, budget: float, stress: int, detour: float, most_time: float, turns: DataFrame | None, most_labels: int | None, score: Column, beats: Callable) -> tuple[DataFrame, DataFrame]:
    """Labels at the destinations (od, label), and (od, labels, stop). `score` is what a label costs, from columns cost, length, capital and those of ods; `beats(a, b)` says whether label a makes b needless."""
    kind = arcs.schema["arc"].dataType.simpleString()
    shortest = legal_lengths(arcs, ods.select("od", "origin", "destination"), turns)
    rest = _rests(arcs, ods)
    limits = _save(ods.join(shortest, "od").withColumn("most_length", F.col("shortest") * detour + EPS).drop("shortest"))
    prices = capital.select("project", "capital")
    can = lambda s, t, p: (s <= stress) | (p.isNotNull() & (t <= stress))
    open_ = arcs.where(can(F.col("stress"), F.col("treated"), F.col("project"))).withColumn("need", F.when(F.col("stress") > stress, F.col("project")))
    open_ = open_.join(prices.toDF("need", "need_capital"), "need", "left").where("need is null or need_capital is not null")
    open_ = _save(open_.select(F.col("arc").alias("next"), F.col("u").alias("node"), F.col("v").alias("to"), F.col("length").alias("m_length"), F.col("time").alias("m_time"), F.col("cost").alias("m_cost"), "need", F.coalesce("need_capital", F.lit(0.0)).alias("need_capital")))
    if turns is not None:
        t = turns.withColumn("turn_need", F.when(F.col("stress") > stress, F.col("project"))).join(prices.toDF("turn_need", "turn_capital"), "turn_need", "left")
        shut = F.col("banned") | ~can(F.col("stress"), F.col("treated"), F.col("project")) | (F.col("turn_need").isNotNull() & F.col("turn_capital").isNull())
        turns = _save(t.select("arc", "next", shut.alias("shut"), "turn_need", F.coalesce("turn_capital", F.lit(0.0)).alias("turn_capital"), "delay"))
    own = [c for c in ods.columns if c not in ("origin", "destination")]
    start = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("length"), F.lit(0.0).alias("time"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("capital"), F.array().cast("array<string>").alias("projects"), F.array().cast(f"array<{kind}>").alias("route"))
    front = limits.where("origin <> destination").select(*own, "destination", "most_length", F.col("origin").alias("node"), F.lit(None).cast(kind).alias("arc"), start.alias("label"))
    known = counts = None
    while True:
        step = front.join(open_, "node").drop("node")
        if turns is not None:
            step = step.join(turns, ["arc", "next"], "left").where("shut is null or not shut")
        else:
            step = step.withColumns({"turn_need": F.lit(None).cast("string"), "turn_capital": F.lit(0.0), "delay": F.lit(0.0)})
        has = lambda need: need.isNull() | F.array_contains("label.projects", F.coalesce(need, F.lit("")))
        again = F.coalesce(F.col("turn_need") == F.col("need"), F.lit(False))
        paid = F.when(has(F.col("need")), 0.0).otherwise(F.col("need_capital")) + F.when(has(F.col("turn_need")) | again, 0.0).otherwise(F.col("turn_capital"))
        projects = F.array_sort(F.array_distinct(F.concat("label.projects", F.array_compact(F.array("need", "turn_need")))))
        step = step.select(*own, "destination", "most_length", F.col("to").alias("node"), F.col("next").alias("arc"), (F.col("label.length") + F.col("m_length")).alias("length"), (F.col("label.time") + F.col("m_time") + F.coalesce("delay", F.lit(0.0))).alias("time"),
                           (F.col("label.cost") + F.col("m_cost") + F.coalesce("delay", F.lit(0.0))).alias("cost"), (F.col("label.capital") + paid).alias("capital"), projects.alias("projects"), F.array_append("label.route", F.col("next")).alias("route"))
        step = step.where(F.col("capital") <= budget + EPS).join(rest, ["destination", "node"]).where((F.col("length") + F.col("rest_length") <= F.col("most_length")) & (F.col("time") + F.col("rest_time") <= most_time + EPS))
        label = F.struct(score.alias("score"), "length", "time", "cost", "capital", "projects", "route")
        at = F.when((F.col("node") != F.col("destination")) & F.lit(turns is not None), F.col("arc"))
        place = [*own, "destination", "most_length", "node", "at"]
        met = step.withColumn("at", at).groupBy(*place).agg(F.sort_array(F.collect_list(label)).alias("new"), F.count("*").alias("made"))
        # sorted: of equal labels the first stays
        first = F.filter("new", lambda x, i: ~F.exists(F.transform("new", lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda o: (o["j"] != i) & beats(o["y"], x) & (~beats(x, o["y"]) | (o["j"] < i))))
        met = met.withColumn("new", first)
        if known is not None:
            met = _joined(met, known)
            met = met.withColumn("new", F.filter("new", lambda x: ~F.exists("labels", lambda o: beats(o, x))))
        met = _save(met.where(F.size("new") > 0))
        if met.isEmpty():
            break
        grown = met.select("od", "node", "at", F.col("new").alias("labels"))
        if known is None:
            known = _save(grown)
        else:
            kept = known.withColumnRenamed("labels", "old").join(grown, [known["od"] == grown["od"], known["node"] == grown["node"], known["at"].eqNullSafe(grown["at"])], "full")
            new = F.coalesce(grown["labels"], F.array().cast(known.schema["labels"].dataType))
            old = F.filter(F.coalesce("old", F.array().cast(known.schema["labels"].dataType)), lambda o: ~F.exists(new, lambda x: beats(x, o)))
            known = _save(kept.select(F.coalesce(known["od"], grown["od"]).alias("od"), F.coalesce(known["node"], grown["node"]).alias("node"), F.coalesce(known["at"], grown["at"]).alias("at"), F.concat(old, new).alias("labels")))
        made = met.groupBy("od").agg(F.sum(F.size("new")).alias("made"))
        counts = _save(made if counts is None else counts.unionByName(made).groupBy("od").agg(F.sum("made").alias("made")))
        front = met.where("node <> destination")
        if most_labels is not None:
            front = front.join(counts.where(F.col("made") >= most_labels).select("od"), "od", "left_anti")
        front = front.select(*own, "destination", "most_length", "node", F.col("at").alias("arc"), F.explode("new").alias("label"))
        front = _save(front)
        if front.isEmpty():
            break
    ends = (known if known is not None else _save(limits.select("od", F.col("origin").alias("node"), F.lit(None).cast(kind).alias("at"), F.array(start).alias("labels")).where("false")))
    goals = ods.select("od", F.col("destination").alias("node"))
    found = ends.join(goals, ["od", "node"]).select("od", F.explode("labels").alias("label"))
    made = counts if counts is not None else ods.select("od", F.lit(0).cast("long").alias("made")).where("false")
    status = ods.select("od").join(shortest.select("od", "shortest"), "od", "left").join(made, "od", "left")
    capped = F.lit(False) if most_labels is None else F.coalesce("made", F.lit(0)) >= most_labels
    stop = F.when(F.col("shortest").isNull(), "disconnected").when(capped, "label_limit").otherwise("exhausted")
    return found, status.select("od", F.coalesce("made", F.lit(0)).alias("labels"), stop.alias("stop"), "shortest")


def _joined(met: DataFrame, known: DataFrame) -> DataFrame:
    """met with the labels known at its places, an empty array where there are none."""
    none = F.array().cast(known.schema["labels"].dataType)
    other = known.select(F.col("od").alias("_od"), F.col("node").alias("_node"), F.col("at").alias("_at"), "labels")
    both = met.join(other, (met["od"] == other["_od"]) & (met["node"] == other["_node"]) & met["at"].eqNullSafe(other["_at"]), "left")
    return both.withColumn("labels", F.coalesce("labels", none)).drop("_od", "_node", "_at")


def label_search(arcs: DataFrame, ods: DataFrame, capital: DataFrame, budget: float, stress: int = 2, detour: float = 1.5, most_time: float = 1800.0, turns: DataFrame | None = None, most_labels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All efficient ways of each od: (od, projects, length, time, cost, capital, route, stop), none as good in projects (by inclusion), length, time and cost as another; and (od, labels, stop, shortest).

    A way costs at most `budget` of capital(project, capital), each project once; it is at most `detour` times as long as the shortest legal way and takes at most most_time. stop: exhausted,
    disconnected, or label_limit, where an od made most_labels labels and what is found so far is given; it stands beside each way too. Without most_labels every search is exhausted and exact.
    Of equal ways the smallest route stays.
    """
    beats = lambda a, b: (F.size(F.array_except(a["projects"], b["projects"])) == 0) & (a["length"] <= b["length"] + EPS) & (a["time"] <= b["time"] + EPS) & (a["cost"] <= b["cost"] + EPS)
    found, status = _search(arcs, ods.select("od", "origin", "destination"), capital, budget, stress, detour, most_time, turns, most_labels, F.col("cost"), beats)
    ways = found.select("od", "label.projects", "label.length", "label.time", "label.cost", "label.capital", "label.route")
    return ways.join(status.select("od", "stop"), "od"), status


def priced_routes(arcs: DataFrame, ods: DataFrame, capital: DataFrame, budget: float, prices: list[tuple[str, float, float]], funded: list[str] | None = None, stress: int = 2, detour: float = 1.5, most_time: float = 1800.0, turns: DataFrame | None = None, most_labels: int | None = None) -> DataFrame:
    """(price, od, projects, length, time, cost, capital, score, route, stop): for each (price, for a unit of length, for a unit of capital not funded) a way of low score inside the limits.

    There is a row for every price and od, without a way where `stop` says why: disconnected, no_way (none inside the limits), label_limit (none or not all was found when the od had made most_labels labels;
    there is no such limit by default), heuristic (capital is priced, or the budget can bind, so that a label that went could have been better later; see priced_exactly), else exact.

    Labels are held against each other by score, length and time only, not by projects, so far fewer stay than in label_search. A label whose projects would have been shared further on may go: as
    with a search label by label, the score is the least of those kept, not of all ways.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("price"), F.lit(float(a)).alias("per_length"), F.lit(float(b)).alias("per_capital")) for n, a, b in prices)))
    own = ods.select("od", "origin", "destination", each.alias("p")).select(F.concat_ws("|", "p.price", F.col("od").cast("string")).alias("od"), F.col("od").alias("journey"), "origin", "destination", "p.*")
    free = F.array(*map(F.lit, funded or [])).cast("array<string>")
    costs = capital.agg(F.map_from_entries(F.collect_list(F.struct("project", "capital"))).alias("m")).first()
    binds = sum((costs.m or {}).values()) > budget + EPS if costs else False
    costs = F.create_map(*[F.lit(x) for kv in (costs.m or {}).items() for x in kv]) if costs and costs.m else F.create_map()  # as long as the list of projects
    charged = F.aggregate(F.array_except("projects", free), F.lit(0.0), lambda s, p: s + costs[p]) if costs is not None else F.lit(0.0)
    score = F.col("cost") + F.col("per_length") * F.col("length") + F.col("per_capital") * charged
    beats = lambda a, b: (a["score"] <= b["score"] + EPS) & (a["length"] <= b["length"] + EPS) & (a["time"] <= b["time"] + EPS)
    found, status = _search(arcs, own, capital, budget, stress, detour, most_time, turns, most_labels, score, beats)
    best = found.groupBy("od").agg(F.min("label").alias("b"))
    rows = own.select("od", "journey", "price", "per_capital").join(status.select("od", F.col("stop").alias("_stop")), "od").join(best, "od", "left")
    stop = F.when(F.col("_stop") != "exhausted", F.col("_stop")).when(F.col("b").isNull(), "no_way").when((F.col("per_capital") != 0) | F.lit(binds), "heuristic").otherwise("exact")
    return rows.select("price", F.col("journey").alias("od"), "b.projects", "b.length", "b.time", "b.cost", "b.capital", "b.score", "b.route", stop.alias("stop"))


def priced_exactly(ways: DataFrame, capital: DataFrame, prices: list[tuple[str, float, float]], funded: list[str] | None = None) -> DataFrame:
    """(price, od, projects, length, time, cost, capital, score, route): the way of least score at each price among the efficient ways of label_search, of equal ones the smallest.

    A score doesn't fall with projects, length, time or cost, so the least of all ways inside the limits is among the efficient ones: this is what priced_routes approximates. An od without a way has no row.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("price"), F.lit(float(a)).alias("per_length"), F.lit(float(b)).alias("per_capital")) for n, a, b in prices)))
    charged = ways.select("od", "projects", F.explode("projects").alias("project")).distinct().where(~F.col("project").isin(funded or [])).join(capital.select("project", F.col("capital").alias("own")), "project")
    charged = charged.groupBy("od", "projects").agg(F.sum("own").alias("charged"))
    priced = ways.join(charged, ["od", "projects"], "left").fillna(0.0, ["charged"]).withColumn("p", each)
    score = F.col("cost") + F.col("p.per_length") * F.col("length") + F.col("p.per_capital") * F.col("charged")
    best = priced.groupBy("p.price", "od").agg(F.min(F.struct(score.alias("score"), "length", "time", "cost", "capital", "projects", "route")).alias("b"))
    return best.select("price", "od", "b.projects", "b.length", "b.time", "b.cost", "b.capital", "b.score", "b.route")
