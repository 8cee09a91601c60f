"""Saved intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new local one where that is unset and all runs on this machine (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, and lost executors cost nothing that was saved."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/streetworth/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bundled(df: DataFrame, *kept: str) -> DataFrame:
    """The columns `kept`, and all others in one struct, `others`, so that none of their names can meet a name given here. restored() undoes it."""
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in kept]
    return df.select(*kept, F.struct(*others or [F.lit(True).alias("none")]).alias("others"))


def restored(df: DataFrame, columns: list[str], *kept: str) -> list:
    """The columns of the table that bundled() took, in order."""
    return [df[c.lower()].alias(c) if c.lower() in kept else df["others"].getField(c).alias(c) for c in columns]


def input_blocks(df: DataFrame) -> int:
    """A number of blocks that grows with the input: its partitions, or the shuffle partitions if these are more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def maybe_in(df: DataFrame, keys: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """df with _maybe: false only where df's key is surely not among the keys. A bit map of 2**bits hashes, at most 2**(bits - 6) rows whatever the keys, so
    that its broadcast is bounded; where it fills up, everything is maybe. It spares wide rows a shuffle in the exact join that follows. df has no column of
    these names: `_p`, `_word`, `_bits`, `_maybe` (see bundled)."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    words = keys.select(place.alias("_p")).distinct().groupBy(F.shiftright("_p", 6).alias("_word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits"))
    df = df.withColumn("_p", place).withColumn("_word", F.shiftright("_p", 6))
    hit = F.expr("coalesce(_bits & shiftleft(1L, cast(_p % 64 as int)), 0L) <> 0")
    return df.join(F.broadcast(words), "_word", "left").withColumn("_maybe", hit).drop("_p", "_word", "_bits")


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its v. The minimum is combined before the shuffle, and the join can be split where a u is hot."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (id, component) for each id in an edge, component being the smallest id reachable.

    Alternating large-star and small-star steps, each a grouped minimum and a join, saved after each round; the number of rounds grows with the
    logarithm of the longest path. Null ends and loops make no link. No edges: no rows.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v")
    pairs = save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _min_neighbour(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = save(small.where("u <> v").distinct(), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
