"""Parquet with geometries: well-known binary and a box for each row, by whose statistics Spark skips row groups.

Geometries are points struct<x,y>, lines array<struct<x,y>>, polygons array<array<struct<x,y>>> (rings) or several polygons, one array deeper.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, StructField, StructType

from streetworth.sources.folders import FolderWriter, Written, listed, opened

# Fixed values of the format: names by depth of arrays, and codes.
NAMES = ("Point", "LineString", "Polygon", "MultiPolygon")
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPolygon": 6}
VERSION = "1.1.0"
_POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def _depth(kind: DataType) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, ArrayType) else 0


def geometry_type(name: str) -> DataType:
    kind: DataType = _POINT
    for _ in range(NAMES.index(name)):
        kind = ArrayType(kind)
    return kind


def encoded(geometry, depth: int) -> bytes:
    """Well-known binary; rings are closed."""
    head = struct.pack("<BI", 1, CODES[NAMES[depth]])
    line = lambda points: struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in points)
    if depth == 0:
        return head + struct.pack("<dd", geometry["x"], geometry["y"])
    if depth == 1:
        return head + line(geometry)
    if depth == 2:
        return head + struct.pack("<I", len(geometry)) + b"".join(line([*r, r[0]] if r and r[0] != r[-1] else r) for r in geometry)
    return head + struct.pack("<I", len(geometry)) + b"".join(encoded(g, 2) for g in geometry)


def decoded(raw: bytes, at: int = 0):
    """(geometry, its end) of well-known binary of either byte order; further coordinates of a point are dropped."""
    order = "<" if raw[at] == 1 else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    more = (code % 10000 // 1000 if code < 2**28 else 0) or (code >> 31) + (code >> 30 & 1) * 2
    wide = 2 + {0: 0, 1: 1, 2: 1, 3: 2}[more]
    at += 5 + 4 * (code >> 29 & 1)
    code = code & 0xFFFF if code >= 2**28 else code
    code %= 1000

    def line(at: int):
        n = struct.unpack_from(order + "I", raw, at)[0]
        flat = struct.unpack_from(f"{order}{n * wide}d", raw, at + 4)
        return [{"x": flat[i], "y": flat[i + 1]} for i in range(0, n * wide, wide)], at + 4 + n * wide * 8

    if code == 1:
        x, y = struct.unpack_from(order + "dd", raw, at)
        return {"x": x, "y": y}, at + 8 * wide
    if code == 2:
        return line(at)
    if code not in (3, 6):
        raise ValueError(f"geometries of code {code} can't be read")
    parts, n = [], struct.unpack_from(order + "I", raw, at)[0]
    at += 4
    for _ in range(n):
        part, at = line(at) if code == 3 else decoded(raw, at)
        parts.append(part)
    return parts, at


def box(geometry: Column, depth: int) -> Column:
    """struct(xmin, ymin, xmax, ymax), null where there is no point."""
    points = F.array(geometry) if depth == 0 else geometry
    for _ in range(depth - 1):
        points = F.flatten(points)
    side = lambda c: F.transform(points, lambda p: p[c])
    edges = F.struct(F.array_min(side("x")).alias("xmin"), F.array_min(side("y")).alias("ymin"), F.array_max(side("x")).alias("xmax"), F.array_max(side("y")).alias("ymax"))
    return F.when(edges["xmin"].isNotNull() & edges["ymin"].isNotNull(), edges)


def as_binary(rows: DataFrame, column: str) -> DataFrame:
    """rows with `column` as well-known binary and its `bbox`; null geometries stay null."""
    if "bbox" in rows.columns and column != "bbox":
        raise ValueError("rows have a column bbox")
    depth = _depth(rows.schema[column].dataType)
    rows = rows.withColumn("bbox", box(F.col(column), depth))
    fields = [StructField(f.name, BinaryType()) if f.name == column else f for f in rows.schema.fields]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(column)
            yield b.set_column(k, column, pa.array([None if g is None else encoded(g, depth) for g in b.column(k).to_pylist()], pa.binary()))

    return rows.mapInArrow(packed, StructType(fields))


def from_binary(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the well-known binary of `column` as geometries of one kind, such as Polygon; others raise."""
    fields = [StructField(f.name, geometry_type(name)) if f.name == column else f for f in rows.schema.fields]
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = point
    for _ in range(NAMES.index(name)):
        kind = pa.list_(kind)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(column)
            yield b.set_column(k, column, pa.array([None if g is None else decoded(g)[0] for g in b.column(k).to_pylist()], kind))

    return rows.mapInArrow(unpacked, StructType(fields))


class _GeometryWriter(FolderWriter):
    def __init__(self, path: str, overwrite: bool, column: str, name: str, rows: int):
        super().__init__(path, overwrite)
        self.column, self.name, self.rows = column, name, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, out, waiting, held = [], None, [], 0
        about = {"encoding": "WKB", "geometry_types": [self.name] if self.name else [], "covering": {"bbox": {side: ["bbox", side] for side in ("xmin", "ymin", "xmax", "ymax")}}}
        meta = {"version": VERSION, "primary_column": self.column, "columns": {self.column: about}}
        try:
            for batch in iterator:
                if out is None:
                    name, store, path = self.file(".parquet")
                    names.append(name)
                    schema = batch.schema.with_metadata({"geo": json.dumps(meta)})
                    out = pq.ParquetWriter(path, schema, filesystem=store, compression="zstd")
                waiting.append(batch)
                held += batch.num_rows
                if held >= self.rows:
                    out.write_table(pa.Table.from_batches(waiting).replace_schema_metadata(schema.metadata), row_group_size=self.rows)
                    waiting, held = [], 0
            if waiting:
                out.write_table(pa.Table.from_batches(waiting).replace_schema_metadata(schema.metadata), row_group_size=self.rows)
        finally:
            if out is not None:
                out.close()
        return Written(names)


class GeometryLedger(DataSource):
    """A writer of files of rows with a well-known binary column and a `bbox`, as as_binary makes them. Options: geometry (its name), kind (such as Polygon), rows (of a row group, 20,000)."""

    @classmethod
    def name(cls) -> str:
        return "geometry_ledger"

    def schema(self) -> StructType:
        raise NotImplementedError("read with read_geometries")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _GeometryWriter(self.options["path"], overwrite, self.options.get("geometry", "geometry"), self.options.get("kind", ""), int(self.options.get("rows", 20_000)))


def write_geometries(rows: DataFrame, path: str, column: str = "geometry", cell: float | None = None, group: int = 20_000) -> None:
    """Write rows to a new folder. With `cell`, rows are dealt over tasks by columns of boxes' cells of that width and sorted in them, so that row groups cover little; many rows of
    one column of cells are parted by their rows of cells."""
    rows.sparkSession.dataSource.register(GeometryLedger)
    name = NAMES[_depth(rows.schema[column].dataType)]
    out = as_binary(rows, column)
    if cell:
        keys = [F.floor(F.col("bbox.xmin") / cell), F.floor(F.col("bbox.ymin") / cell)]
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out.write.format("geometry_ledger").options(geometry=column, kind=name, rows=group).mode("append").save(path)


def read_geometries(spark: SparkSession, path: str, name: str, within: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows of such files, with geometries of one kind (Point, LineString, Polygon, MultiPolygon); those whose box meets `within` (x1, y1, x2, y2), if given.

    The first file's metadata says which column has the geometries, and under which names the sides of the boxes stand. The comparison with the box is Spark's own and reaches the scan. A file without boxes
    can be read whole only. A folder without files is refused, as it has no columns.
    """
    found = listed(path, ".parquet")
    if not found:
        raise ValueError(f"{path} has no files")
    store, _ = opened(path)
    meta = json.loads((pq.read_schema(found[0], filesystem=store).metadata or {}).get(b"geo", b"{}"))
    column = meta.get("primary_column")
    about = meta.get("columns", {}).get(column, {})
    if about.get("encoding") != "WKB":
        raise ValueError(f"{found[0]} has no geometries in well-known binary")
    rows = spark.read.parquet(path)
    if within:
        if "covering" not in about:
            raise ValueError(f"{found[0]} has no boxes")
        side = {k: F.col(".".join(f"`{part}`" for part in v)) for k, v in about["covering"]["bbox"].items()}
        x1, y1, x2, y2 = within
        rows = rows.where((side["xmin"] <= x2) & (side["xmax"] >= x1) & (side["ymin"] <= y2) & (side["ymax"] >= y1))
    return from_binary(rows, column, name)


def coordinates(geometry: Column, name: str, digits: int | None = None) -> Column:
    """A geometry as nested arrays of numbers, rounded to `digits`; rings are closed. For writers.write_features with kind=name."""
    at = lambda c: F.round(c, digits) if digits is not None else c
    flat = lambda p: F.array(at(p["x"]), at(p["y"]))
    line = lambda ps: F.transform(ps, flat)
    ring = lambda ps: line(F.when((F.size(ps) > 0) & (F.get(ps, F.lit(0)) != F.get(ps, F.size(ps) - 1)), F.concat(ps, F.slice(ps, 1, 1))).otherwise(ps))
    polygon = lambda rings: F.transform(rings, ring)
    return {"Point": flat, "LineString": line, "Polygon": polygon, "MultiPolygon": lambda ps: F.transform(ps, polygon)}[name](geometry)


def read_shapes(spark: SparkSession, path: str, properties: str, name: str, by_line: bool = False) -> DataFrame:
    """Features of one kind of geometry: their properties and `geometry`. Collections are read whole by one task each; with by_line a feature stands on each line, and files are parted.

    Null geometries stay null, a feature of another kind raises. Numbers after the second of a point are dropped.
    """
    depth = NAMES.index(name)
    nested = "array<" * (depth + 1) + "double" + ">" * (depth + 1)
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: {nested}>>"
    reader = spark.read.option("multiLine", not by_line)
    if by_line:
        rows = reader.schema(f"properties struct<{properties}>, geometry struct<type: string, coordinates: {nested}>").json(path).select(F.struct("properties", "geometry").alias("f"))
    else:
        whole = reader.schema(f"type string, features array<{feature}>").json(path)
        checked = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast(f"array<{feature}>"))
        rows = whole.select(F.explode(checked).alias("f"))

    def shaped(c: Column, left: int) -> Column:
        return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")) if left == 0 else F.transform(c, lambda v: shaped(v, left - 1))

    kind, given = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    other = F.raise_error(F.concat(F.lit("a feature is a "), kind)).cast(geometry_type(name))
    return rows.select("f.properties.*", F.when(kind.isNull(), None).when(kind != name, other).otherwise(F.when(given.isNotNull(), shaped(given, depth))).alias("geometry"))
