"""Queries on rasters that stand in files: mean prices of parts by cells of 100 m, written as images and read back by tiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.operators import rasters as R
from streetworth.operators.graph import shared_dir
from streetworth.plans import fixtures as X
from streetworth.plans.fixtures import table
from streetworth.registry import query
from streetworth.sources.rasters import SCHEMA, RasterTiles

_CELLS = """cells AS (SELECT (p_partkey * 7919 % 10007) // 100 AS col, 102 - (p_partkey * 104729 % 10009) // 100 AS row, max(CAST(round(p_retailprice * 8) AS BIGINT)) / 8e0 AS z FROM part GROUP BY 1, 2),
sites AS (SELECT s_suppkey AS id, CAST(s_suppkey * 6007 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 3001 % 10009 AS DOUBLE) AS y FROM supplier)"""
_TOP = 103 * 100


def _sites(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(s.alias("id"), (s * 6007 % 10007).cast("double").alias("x"), (s * 3001 % 10009).cast("double").alias("y"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """The dearest part of each cell, through files of 32 x 32 cells in tiles of 16 x 16; rows count from y = 10,300 downwards."""
    spark.dataSource.register(RasterTiles)
    path = f"{shared_dir(spark)}/streetworth/raster-{uuid.uuid4().hex}"
    p = X.points(spark, d, "part", "p_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "id")
    cells = p.groupBy(F.floor(F.col("x") / 100).alias("col"), (102 - F.floor(F.col("y") / 100)).alias("row")).agg((F.max(F.round(F.col("p_retailprice") * 8).cast("long")) / 8).alias("value"))
    windows = R.gathered_tiles(cells, 32, 100.0).withColumn("y", F.col("y") + _TOP)
    windows.write.format("raster_tiles").option("tile", 16).mode("append").save(path)
    return spark.read.format("raster_tiles").schema(SCHEMA).load(path)


@query(f"WITH {_CELLS} SELECT id, z AS value FROM sites LEFT JOIN cells ON col = CAST(floor(x / 100) AS BIGINT) AND row = CAST(floor(({_TOP} - y) / 100) AS BIGINT)")
def raster_file_samples(spark: SparkSession, d: str) -> DataFrame:
    """The value of the raster's files under each site."""
    return R.sampled(_sites(spark, d), tiles(spark, d), 1600.0)


@query(f"""WITH {_CELLS}, m AS (SELECT id, z FROM sites JOIN cells ON pow(col * 100 + 50 - x, 2) + pow({_TOP} - row * 100 - 50 - y, 2) <= 90000)
SELECT id, count(z) AS cells, round(median(z), 6) AS median, max(z) AS most FROM sites LEFT JOIN m USING (id) GROUP BY 1""")
def raster_file_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number, median and maximum of the cells of the raster's files within 300 m of each site."""
    sites = _sites(spark, d)
    sums = R.around(sites, tiles(spark, d), 1600.0, 300.0).groupBy("id").agg(F.count("*").alias("cells"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.max("value").alias("most"))
    return sites.select("id").join(sums, "id", "left").fillna(0, ["cells"])
