"""Graph operators as rounds of joins and grouped minima; each round is a written table, so that lineage stays short and lost executors cost one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new local one where that is unset and all runs on this machine (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _save(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/streetworth/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Weak components of edges(a, b): (id, component) with the smallest id reachable.

    A round hands each node its neighbours' least label, hooks the node that names a label to the least label that any of its nodes met, and jumps along the labels; whole trees join at once,
    so that long chains and rings need about log2 of their length in rounds. It ends when nothing changes.
    """
    both = _save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = _save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        met = _save(labels.join(near, F.col("id") == F.col("a")).select("id", "component", F.least("near", "component").alias("near")))
        hooks = met.groupBy(F.col("component").alias("root")).agg(F.min("near").alias("hook"))
        lower = met.join(hooks, F.col("id") == F.col("root"), "left").select("id", F.col("component").alias("old"), F.least("near", F.coalesce("hook", "near")).alias("component"))
        up = lower.select(F.col("id").alias("up"), F.col("component").alias("higher"))
        moved = _save(lower.join(up, F.col("component") == F.col("up")).select("id", "old", F.least("component", "higher").alias("component")))
        changed = moved.where("old <> component").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels


def shortest_costs(arcs: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """Least cost from each source over directed arcs(u, v, cost >= 0), up to `limit`: (source, node, cost). Only nodes that got cheaper in a round go on in the next."""
    least = arcs.groupBy("u", "v").agg(F.min("cost").alias("cost"))
    known = front = _save(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    while True:
        step = front.join(least.withColumnRenamed("cost", "more"), F.col("node") == F.col("u"))
        reached = step.groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("more")).alias("cost")).where(F.col("cost") <= limit)
        old = known.withColumnRenamed("cost", "old")
        better = _save(reached.join(old, ["source", "node"], "left").where("old is null or cost < old").select("source", "node", "cost"))
        if not better.limit(1).count():
            return known
        known, front = _save(known.unionByName(better).groupBy("source", "node").agg(F.min("cost").alias("cost"))), better
