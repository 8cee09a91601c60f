"""Readers of the domain's source formats, each a distributed scan: checked CSV, zipped CSV, JSON records, GeoJSON features, workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from streetworth.operators.graph import _save


def read_csv_checked(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, all columns strings; a byte order mark is dropped. Raises where a required column is missing."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", False).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return rows


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents {"records": [...]}."""
    return spark.read.option("multiLine", True).schema(f"records array<struct<{schema}>>").json(path).select(F.inline("records"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections: their properties, and the geometry's type and its coordinates as JSON text."""
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"
    rows = spark.read.option("multiLine", True).schema(f"type string, features array<{feature}>").json(path)
    kind = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast(f"array<{feature}>"))
    each = rows.select(F.explode(kind).alias("f"))
    return each.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of one CSV member of ZIP archives, such as a transit feed: (archive, columns...), all strings, null where the member lacks a column."""
    return unzipped_csv(spark.read.format("binaryFile").load(path).select("path", "content"), member, columns)


def unzipped_csv(files: DataFrame, member: str, columns: list[str]) -> DataFrame:
    """The same for files(path, content). One archive is one task's work, whose memory follows the archive; its rows are read in pieces of 50,000."""
    schema = ", ".join(["archive string", *(f"`{c}` string" for c in columns)])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if member not in archive.namelist():
                        raise ValueError(f"{name} has no {member}")
                    with archive.open(member) as file:
                        for piece in pd.read_csv(file, dtype=str, encoding="utf-8-sig", chunksize=50_000, keep_default_na=False):
                            yield piece.reindex(columns=columns).astype(object).where(lambda p: p.notna(), None).assign(archive=name)[["archive", *columns]]

    return files.select("path", "content").mapInPandas(rows, schema)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(reference: str) -> int:
    """Place of a cell such as AB12, from 0."""
    place = 0
    for letter in re.match("[A-Z]+", reference).group():
        place = place * 26 + ord(letter) - 64
    return place - 1


class _WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with zipfile.ZipFile(partition.value) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in item.iterfind(".//m:t", _NS)) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
            with book.open("xl/worksheets/sheet1.xml") as sheet:
                for _, row in ElementTree.iterparse(sheet):
                    if row.tag != f"{{{_NS['m']}}}row":
                        continue
                    for cell in row.iterfind("m:c", _NS):
                        value, kind = cell.findtext("m:v", None, _NS), cell.get("t")
                        if kind == "inlineStr":
                            value = "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS))
                        elif kind == "s" and value is not None:
                            value = shared[int(value)]
                        if value is not None:
                            yield partition.value, int(row.get("r")), _column(cell.get("r")), value
                    row.clear()


class Workbook(DataSource):
    """Cells (file, row, column, value) of the first sheets of workbooks; rows count from 1 and columns from 0, values are text. Option `paths`: comma-separated
    files that all executors can open. One file is one partition.

    Register with spark.dataSource.register(Workbook), then spark.read.format("workbook").option("paths", ...).load().
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, row int, column int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _WorkbookReader([p for p in self.options["paths"].split(",") if p])


def counter_series(cells: DataFrame, header_row: int = 3) -> DataFrame:
    """Daily counts (file, site, day, count) of workbook cells: site names stand in the header row from the second column on, serial dates in the first column."""
    sites = cells.where((F.col("row") == header_row) & (F.col("column") > 0)).select("file", "column", F.trim("value").alias("site"))
    days = cells.where((F.col("row") > header_row) & (F.col("column") == 0)).select("file", "row", F.date_add(F.lit("1899-12-30").cast("date"), F.floor(F.expr("try_cast(value as double)")).cast("int")).alias("day"))
    counts = cells.where((F.col("row") > header_row) & (F.col("column") > 0)).select("file", "row", "column", F.expr("try_cast(value as double)").alias("count"))
    return counts.join(sites, ["file", "column"]).join(days, ["file", "row"]).where("day is not null and count is not null").select("file", "site", "day", "count")


def require_count(rows: DataFrame, expected: int | None = None, least: int | None = None) -> DataFrame:
    """rows, after checking their number; raises ValueError where it is not the expected one or below the least. They are saved first, so that the plan runs once."""
    rows = _save(rows)
    found = rows.count()
    if (expected is not None and found != expected) or (least is not None and found < least):
        raise ValueError(f"{found} rows; expected {expected if expected is not None else f'at least {least}'}")
    return rows


def merged_pages(pages: DataFrame, key: str, expected: int) -> DataFrame:
    """One row (key, pages, status) for each record of paged results pages(page, key, ...), and one of null key where the number of records is not the expected one.

    A record that comes on two pages is repeated and not dropped: a source that shifts between pages must not pass.
    """
    each = pages.groupBy(key).agg(F.count("*").alias("pages")).select(key, "pages", F.when(F.col("pages") > 1, "repeated").otherwise("ok").alias("status"))
    short = pages.agg(F.count_distinct(key).alias("pages")).where(F.col("pages") != expected).select(F.lit(None).cast(pages.schema[key].dataType).alias(key), "pages", F.lit("count_differs").alias("status"))
    return each.unionByName(short)


def whole_ways(nodes: DataFrame, stops: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """stops(way, place, node) of all ways that have a node of nodes(node, x, y) inside box(x1, y1, x2, y2), whole, with the nodes' coordinates (null where a node is not known)."""
    x1, y1, x2, y2 = box
    inside = nodes.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2)).select("node")
    ways = stops.join(inside, "node", "left_semi").select("way").distinct()
    return stops.join(ways, "way", "left_semi").join(nodes, "node", "left").select("way", "place", "node", "x", "y")
