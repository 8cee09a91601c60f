"""Writers: compressed ledgers, canonical JSON, GeoJSON features, guarded CSV, and the dictionary form of repeated metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from streetworth.functions.columns import csv_guard


def write_ledger(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet under zstd, in folders of `by`. Spark commits whole jobs only, so readers never see half a ledger."""
    writer = rows.write.option("compression", "zstd").mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def canonical_json(rows: DataFrame) -> Column:
    """A row as JSON with its columns in order of name and nulls kept, equal for equal rows; hash it for a stable id."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"})


def stable_id(rows: DataFrame, digits: int = 16) -> Column:
    return F.substring(F.sha2(canonical_json(rows), 256), 1, digits)


def write_features(rows: DataFrame, path: str, coordinates: str = "coordinates", kind: str = "LineString") -> None:
    """One GeoJSON feature a line; `coordinates` is an array, all other columns are properties. Lines are written by all tasks, so nothing is gathered."""
    properties = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != coordinates))
    geometry = F.struct(F.lit(kind).alias("type"), F.col(coordinates).alias("coordinates"))
    rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value")).write.text(path)


def write_guarded_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, in which no text can be taken for a formula."""
    guarded = [csv_guard(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in rows.schema.fields]
    rows.select(*guarded).write.option("header", True).csv(path)


def encode_compact(rows: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(references, dictionary): rows with their metrics replaced by metric_id, and each distinct set of metrics once. Ids are hashes of the values, so they need no
    global order; equal metrics always meet in one id."""
    as_struct = F.struct(*(F.col(m) for m in metrics))
    named = rows.withColumn("metric_id", F.sha2(F.to_json(as_struct, {"ignoreNullFields": "false"}), 256))
    return named.drop(*metrics), named.select("metric_id", *metrics).dropDuplicates(["metric_id"])


def decode_compact(references: DataFrame, dictionary: DataFrame) -> DataFrame:
    return references.join(dictionary, "metric_id").drop("metric_id")
