"""Mixing sources to target weights.

A token budget flows down a tree of domains, languages and sources. Siblings get shares by weight; what one of them can't use goes to its siblings, and
only what all siblings together can't use goes on to the relatives of their parent. A leaf's documents are read in seeded epochs, each in an order of
its own, and the leaf's budget is a prefix of that stream of tokens. All of it is aggregation, windows over the nodes of the tree and joins with
them; the documents themselves are only counted and filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetworth.llm._common import save

LEVELS = ("domain", "lang", "source")
WORDS = r"[^\x20\x09-\x0D]+"


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    given = weights.get(level) or {}
    found = F.lit(None).cast("double")
    for name, w in given.items():
        found = F.when(F.col(level) == name, float(w)).otherwise(found)
    return F.coalesce(found, F.lit(1.0))


def _fill(nodes: DataFrame, parents: list[str], level: str, budget: Column, weights: dict[str, dict[str, float]]) -> DataFrame:
    """Give each node of a level min(its room, water level * weight), the level being what uses up the parent's budget.

    Sorted by room / weight, the water level is the largest of (budget - rooms before) / (weights from here on). Weight 0: nothing.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    nodes = nodes.withColumn("w", _weight(level, weights)).withColumn("room", F.when(F.col("w") > 0, F.col("room")).otherwise(0)).withColumn("budget", budget)
    order = group.orderBy(F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(-1.0), level)
    before = F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("room")
    here_on = F.sum("w").over(group) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("w")
    nodes = nodes.withColumn("level", F.when(F.col("w") > 0, (F.col("budget") - before) / here_on))
    return nodes.withColumn("given", F.least(F.col("room").cast("double"), F.coalesce(F.max("level").over(group), F.lit(0.0)) * F.col("w"))).drop("w", "level", "budget")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `given`, each leaf's budget in whole tokens."""
    leaves = leaves.withColumn("room", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room"))
    domains = langs.groupBy("domain").agg(F.sum("room").alias("room"))
    total = leaves.agg(F.sum("tokens").alias("tokens"))
    domains = _fill(domains.crossJoin(F.broadcast(total)), [], "domain", budget, weights).select("domain", F.col("given").alias("from_domain"))
    langs = _fill(langs.join(domains, "domain"), ["domain"], "lang", F.col("from_domain"), weights).select("domain", "lang", F.col("given").alias("from_lang"))
    return _fill(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", F.col("from_lang"), weights).withColumn("given", F.floor("given").cast("long"))


def _met(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows with their leaf's line of the plan. One leaf may hold a third of all rows: a plan of few lines is broadcast, a longer one is repeated for 16 parts of every leaf."""
    if few:
        return rows.join(F.broadcast(plan), list(LEVELS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(16)).cast("int"))
    return rows.join(plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))), [*LEVELS, "part"]).drop("part")


def _numbered(ties: DataFrame) -> DataFrame:
    """The rows that share a leaf's cut with `nth`, their number in the leaf from 0: counted in each partition of a saved table, and then carried on."""
    ties = save(ties.withColumn("deal", F.spark_partition_id()), "ties")
    counts = ties.groupBy(*LEVELS, "deal").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("deal")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy(*LEVELS, "deal").orderBy("doc_id")) - 1
    return ties.withColumn("own", own).join(counts, [*LEVELS, "deal"]).withColumn("nth", F.col("before") + F.col("own")).drop("deal", "own", "before")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], share: float = 0.8, max_epochs: int = 2, seed: int = 17, most_broadcast: int = 100_000) -> DataFrame:
    """docs with domain, n_tokens (words), epoch and taken (the tokens of this row inside the leaf's prefix); one row for each document and epoch in which it is taken.

    The budget is `share` of all tokens. Null languages and sources form leaves named "?"; null and empty texts have no tokens and are never taken. In a leaf's
    last epoch documents come in the order of md5("seed:epoch:doc_id") and then of their tokens; rows that are equal in both are taken one after the other, so
    that a leaf takes its budget to the token with repeated rows too (which of such rows is the cut one is open). Other columns stay, whatever their names; those
    named domain, n_tokens, epoch or taken are replaced. A plan of over `most_broadcast` leaves is joined, not broadcast. An empty table gives no rows.
    """
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    known = F.lit("?")
    keyed = [F.coalesce(domain, known).alias("domain"), F.coalesce("lang", known).alias("lang"), F.coalesce("source", known).alias("source"), n_tokens.alias("n_tokens")]
    small = docs.select("doc_id", *keyed).where("n_tokens > 0")
    leaves = save(small.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    few = leaves.count() <= most_broadcast
    plan = leaf_budgets(leaves, weights, F.col("tokens") * share, max_epochs).where("given > 0")
    plan = save(plan.select(*LEVELS, F.floor(F.col("given") / F.col("tokens")).cast("int").alias("whole"), (F.col("given") % F.col("tokens")).alias("rest")), "plan")

    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    placed = _met(small, plan.where("rest > 0"), few).withColumn("place", place).withColumn("bucket", F.substring("place", 1, 3))
    buckets = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("tokens")
    edge = buckets.withColumn("before", before).where("before < rest and before + tokens >= rest").select(*LEVELS, F.col("bucket").alias("edge"), "before")
    near = _met(placed, edge, few).where("bucket = edge").groupBy(*LEVELS, "before", "rest", "place", "n_tokens").agg(F.count("*").alias("ties"))
    own = F.col("n_tokens") * F.col("ties")
    start = F.col("before") + F.sum(own).over(Window.partitionBy(*LEVELS).orderBy("place", "n_tokens")) - own
    near = near.withColumn("start", start).where("start < rest")
    last = F.struct(F.col("place").alias("last_place"), F.col("n_tokens").alias("last_tokens"), (F.col("rest") - F.col("start")).alias("last_taken"), "ties")
    cuts = near.groupBy(*LEVELS).agg(F.max_by(last, F.struct("place", "n_tokens")).alias("cut"))
    plan = save(plan.join(cuts, list(LEVELS), "left").select(*LEVELS, "whole", "rest", "cut.*"), "cuts")

    columns = [c for c in docs.columns if c.lower() not in ("domain", "n_tokens", "epoch", "taken")]
    rows = docs.select("doc_id", *keyed, F.struct(*(F.col(f"`{c}`") for c in columns)).alias("others")).where("n_tokens > 0")
    rows = _met(rows, plan, few).withColumn("place", place)
    mine, cut = F.struct("place", "n_tokens"), F.struct(F.col("last_place").alias("place"), F.col("last_tokens").alias("n_tokens"))
    partly = F.when((F.col("rest") > 0) & (mine < cut), F.col("n_tokens")).when((F.col("rest") > 0) & (mine == cut), F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("last_taken") - F.col("nth") * F.col("n_tokens")))).otherwise(0)
    first = F.lit(0).cast("long").alias("nth")
    if plan.where("ties > 1").isEmpty():
        rows = rows.select("*", first)
    else:
        tied = F.coalesce((F.col("rest") > 0) & (F.col("ties") > 1) & (mine == cut), F.lit(False))
        rows = rows.where(~tied).select("*", first).unionByName(_numbered(rows.where(tied)))
    rows = rows.withColumn("partly", partly)
    epochs = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("partly") > 0, 0).otherwise(1))
    rows = rows.where("whole > 0 or partly > 0").withColumn("epoch", F.explode(epochs))
    taken = F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(F.col("partly")).cast("long")
    return rows.select(*(F.col("others").getField(c).alias(c) for c in columns), "domain", "n_tokens", "epoch", taken.alias("taken"))
