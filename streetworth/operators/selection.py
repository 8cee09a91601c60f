"""Operators of selection: top sums, agreement of rankings, dominance, discounting, designed draws, build orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetworth.functions.columns import odds_response
from streetworth.operators.graph import _save


def top_sum(rows: DataFrame, by: list[str], value: str, key: str, k: int) -> DataFrame:
    """Sum of the k largest values of each group as `top`, ties to the smaller key. The first window, over salted parts, leaves at most k rows of each part,
    so that a hot group is never ranked in one task."""
    order = [F.desc(value), F.col(key)]
    parts = rows.select(*by, value, key, F.pmod(F.xxhash64(key), F.lit(32)).alias("_part"))
    few = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_r") <= k)
    last = few.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k)
    return last.groupBy(*by).agg(F.sum(value).alias("top"))


def inversions(x: np.ndarray) -> int:
    """Pairs of positions in falling order, counted as runs of doubling length are merged."""
    x, width, total = np.asarray(x), 1, 0
    while width < len(x):
        for a in range(0, len(x) - width, 2 * width):
            left, right = x[a : a + width], x[a + width : a + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            x[a : a + 2 * width] = np.sort(x[a : a + 2 * width], kind="stable")
        width *= 2
    return total


def agreement(ranked: DataFrame, case: str, key: str, rank: str, central: str, k: int) -> DataFrame:
    """(case, jaccard, tau): overlap of the first k by `rank` and by `central`, and Kendall's tau. Ranks have no ties. A case is one task's group, as long as the list of
    candidates; inversions are counted by merging, not by pairs."""
    kind = ranked.schema[case].dataType.simpleString()

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        value = 1 - 4 * inversions(pdf.sort_values(central)[rank].to_numpy().copy()) / (n * (n - 1)) if n > 1 else None
        return pd.DataFrame({case: [pdf[case].iloc[0]], "tau": [value]})

    a = ranked.select(case, key, rank, central)
    both = a.groupBy(case).agg(F.count_if((F.col(rank) <= k) & (F.col(central) <= k)).alias("_n"), F.count_if((F.col(rank) <= k) | (F.col(central) <= k)).alias("_m"))
    return both.join(a.groupBy(case).applyInPandas(tau, f"{case} {kind}, tau double"), case).select(case, (F.col("_n") / F.col("_m")).alias("jaccard"), "tau")


def _skyline(more: list[str], less: list[str]):
    """Of each partition's rows those that no other of them makes needless, held against what is kept so far, 1024 at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            for at in range(0, len(frame), 1024):
                both = pd.concat([kept, frame.iloc[at : at + 1024]]) if kept is not None else frame.iloc[at : at + 1024]
                x = both[more + less].to_numpy(float) * np.array([1.0] * len(more) + [-1.0] * len(less))
                keep = np.ones(len(x), bool)
                for i in np.argsort(-x.sum(1), kind="stable"):
                    if keep[i]:
                        keep &= ~((x[i] >= x).all(1) & (x[i] > x).any(1))
                kept = both[keep]
        if kept is not None:
            yield kept

    return run


def pareto_many(rows: DataFrame, key: str, more: list[str], less: list[str]) -> DataFrame:
    """rows with `efficient`: false where another row is at least as good in every objective and better in one.

    Each partition first keeps its own efficient rows; whatever makes a row needless is, or is itself beaten by, one of these, so the theta join is between them
    only. For one cost and one benefit use `pareto`, which needs windows only. Objectives are not null.
    """
    few = _save(rows.select(key, *more, *less).mapInPandas(_skyline(more, less), rows.select(key, *more, *less).schema))
    other = few.select(*(F.col(c).alias(f"_{c}") for c in [*more, *less]))
    no_worse = F.lit(True)
    better = F.lit(False)
    for c in more:
        no_worse, better = no_worse & (F.col(f"_{c}") >= F.col(c)), better | (F.col(f"_{c}") > F.col(c))
    for c in less:
        no_worse, better = no_worse & (F.col(f"_{c}") <= F.col(c)), better | (F.col(f"_{c}") < F.col(c))
    kept = few.join(other, no_worse & better, "left_anti").select(key).withColumn("efficient", F.lit(True))
    return rows.join(kept, key, "left").fillna(False, ["efficient"])


def discount_schedule(years: int, steps: list[tuple[int, float]]) -> Column:
    """array<struct<year, growth>>: growth is the product of 1 + rate up to the year, each rate holding up to the year beside it. Made of literals, so no join."""
    out, growth = [], 1.0
    for year in range(1, years + 1):
        growth *= 1 + next(rate for until, rate in steps if year <= until)
        out.append(F.struct(F.lit(year).alias("year"), F.lit(growth).alias("growth")))
    return F.array(*out)


def latin_hypercube(spark: SparkSession, parameters: list[str], n: int, seed: int) -> DataFrame:
    """(parameter, draw, u): u lies in a different n-th of [0, 1) for each draw of a parameter; strata are shuffled by hash, so a rerun gives the same design."""
    rows = spark.range(n).select(F.explode(F.array(*map(F.lit, parameters))).alias("parameter"), F.col("id").alias("draw"))
    name = F.concat_ws("|", F.lit(str(seed)), "parameter", F.col("draw").cast("string"))
    stratum = F.row_number().over(Window.partitionBy("parameter").orderBy(F.sha2(name, 256), "draw")) - 1
    within = F.conv(F.substring(F.sha2(F.concat(F.lit("u|"), name), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    return rows.select("parameter", "draw", ((stratum + within) / n).alias("u"))


def greedy_sequence(savings: DataFrame, paths: DataFrame, ods: DataFrame, projects: DataFrame, theta: float, elasticity: float, share: float) -> DataFrame:
    """Build order (step, candidate, cost, marginal, total): each step takes the affordable candidate of most marginal users for its cost, given all built before.

    savings(od, path, candidate, saving), paths(od, path, cost, probability), ods(od, eligible, base), projects(candidate, cost); the budget is `share` of
    all costs. Ties go to the larger gain, then the smaller cost, then the larger name. One Spark job a step values all remaining candidates at once from a saved
    state: the weight p * exp(theta * saving so far) of each path and its sum over each od. Only paths with a saving are touched, and the driver
    holds one row a step.
    """
    spark = savings.sparkSession
    budget = projects.agg(F.sum("cost")).first()[0] or 0.0
    budget *= share
    savings = _save(savings.where("saving > 0"))
    expected = paths.groupBy("od").agg(F.sum(F.col("probability") * F.col("cost")).alias("expected"))
    weights = _save(paths.select("od", "path", "probability", F.col("probability").alias("weight")))
    pairs = _save(expected.join(ods, "od").withColumns({"mass": F.lit(1.0), "added": F.lit(0.0)}))
    steps: list[tuple[int, str, float, float, float]] = []
    total = 0.0
    while True:
        grown = savings.join(weights, ["od", "path"]).groupBy("candidate", "od").agg(F.sum(F.col("weight") * (F.exp(theta * F.col("saving")) - 1)).alias("more"))
        after = F.col("expected") - F.log(F.col("mass") + F.col("more")) / theta
        now = odds_response(F.col("eligible"), F.col("base"), F.col("expected"), after, elasticity)
        values = grown.join(pairs, "od").groupBy("candidate").agg(F.sum(now - F.col("added")).alias("marginal"))
        open_ = values.join(projects.select("candidate", "cost"), "candidate").where((F.col("cost") <= budget) & (F.col("marginal") > 1e-12))
        if steps:
            open_ = open_.where(~F.col("candidate").isin([s[1] for s in steps]))
        best = open_.orderBy(F.desc(F.col("marginal") / F.col("cost")), F.desc("marginal"), "cost", F.desc("candidate")).first()
        if best is None:
            break
        total, budget = total + best.marginal, budget - best.cost
        steps.append((len(steps) + 1, best.candidate, best.cost, best.marginal, total))
        own = savings.where(F.col("candidate") == best.candidate).select("od", "path", "saving")
        raised = weights.join(own, ["od", "path"], "left").select("od", "path", "probability", (F.col("weight") * F.exp(theta * F.coalesce("saving", F.lit(0.0)))).alias("weight"))
        weights = _save(raised)
        mass = weights.groupBy("od").agg((1 + F.sum(F.col("weight") - F.col("probability"))).alias("mass"))  # exactly 1 where nothing is saved
        state = pairs.drop("mass", "added").join(mass, "od")
        cost = F.col("expected") - F.log("mass") / theta
        pairs = _save(state.withColumn("added", odds_response(F.col("eligible"), F.col("base"), F.col("expected"), cost, elasticity)))
    return spark.createDataFrame(steps, "step int, candidate string, cost double, marginal double, total double")
