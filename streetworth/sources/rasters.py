"""Raster files (tagged images with a place on the map), read tile by tile and written one window a file.

    spark.dataSource.register(RasterTiles)
    tiles = spark.read.format("raster_tiles").load("/shared/heights")

The driver reads the directories of the files only; tasks fetch and unpack runs of whole tiles.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from streetworth.sources.folders import FolderWriter, Written, listed, opened

SCHEMA = "file string, tile int, x double, y double, dx double, dy double, width int, height int, values array<double>"
_ARROW = pa.schema([("file", pa.string()), ("tile", pa.int32()), *((c, pa.float64()) for c in ("x", "y", "dx", "dy")), ("width", pa.int32()), ("height", pa.int32()), ("values", pa.list_(pa.float64()))])
# Fixed values of the file format: tags, codes of field types, of compression and of number kinds.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, NUMBERS, SCALE, TIEPOINT, TRANSFORM, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
STORED, DEFLATED = 1, (8, 32946)
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Layout:
    """What a file's first directory says of its tiles; strips are tiles as wide as the image."""

    order: str
    width: int
    height: int
    tile: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    kind: str
    samples: int
    planar: bool
    packed: bool
    predictor: int
    corner: tuple[float, float]
    step: tuple[float, float]
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[0])

    @property
    def count(self) -> int:
        return self.across * -(-self.height // self.tile[1])


def layout(read) -> Layout:
    """Of a file, read(bytes, place) giving its bytes. What can't be read is refused: other compressions, turned images, images without a place."""
    head = read(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a tagged image")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    wide, unit = (8, "Q") if big else (2, "H")
    entries = struct.unpack(order + unit, read(wide, at))[0]
    each, inline = (20, 8) if big else (12, 4)
    rows = read(entries * each, at + wide)
    tags = {}
    for i in range(entries):
        row = rows[i * each : (i + 1) * each]
        tag, kind = struct.unpack(order + "HH", row[:4])
        if kind not in TYPES:
            continue
        n = struct.unpack(order + ("Q" if big else "I"), row[4 : each - inline])[0]
        size = n * struct.calcsize(TYPES[kind])
        raw = row[each - inline :][:size] if size <= inline else read(size, struct.unpack(order + ("Q" if big else "I"), row[each - inline :])[0])
        tags[tag] = raw if kind == 2 else struct.unpack(f"{order}{n}{TYPES[kind]}", raw)
    one = lambda tag, default: tags[tag][0] if tag in tags else default
    if one(COMPRESSION, STORED) != STORED and one(COMPRESSION, STORED) not in DEFLATED:
        raise ValueError(f"images of compression {one(COMPRESSION, STORED)} can't be read")
    if TRANSFORM in tags or SCALE not in tags or TIEPOINT not in tags:
        raise ValueError("an image without a place, or a turned one")
    bits, numbers, predictor = set(tags.get(BITS, (1,))), set(tags.get(NUMBERS, (1,))), one(PREDICTOR, 1)
    if len(bits) > 1 or len(numbers) > 1 or not bits <= {8, 16, 32, 64} or not numbers <= set(KINDS) or predictor not in (1, 2, 3):
        raise ValueError("numbers of this kind can't be read")
    tiled = TILES in tags
    i, j, _, x, y, _ = tags[TIEPOINT][:6]
    dx, dy = tags[SCALE][:2]
    nodata = tags[NODATA].rstrip(b"\0 ").decode() if NODATA in tags else ""
    return Layout(
        order, one(WIDTH, 0), one(HEIGHT, 0), (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (one(WIDTH, 0), min(one(STRIP_ROWS, one(HEIGHT, 0)), one(HEIGHT, 0))), tags[TILES if tiled else STRIPS],
        tags[TILE_BYTES if tiled else STRIP_BYTES], f"{KINDS[min(numbers)]}{min(bits) // 8}", one(SAMPLES, 1), one(PLANAR, 1) == 2, one(COMPRESSION, STORED) != STORED, predictor, (x - i * dx, y + j * dy), (dx, dy), float(nodata) if nodata else None,
    )


def tile_values(info: Layout, tile: int, band: int, raw: bytes) -> np.ndarray:
    """The numbers of a tile's part inside the image, NaN where there is none."""
    w, h = info.tile
    top, left = tile // info.across * h, tile % info.across * w
    rows = min(h, info.height - top)
    samples = 1 if info.planar else info.samples
    if not raw:  # a tile that was left out
        return np.full((rows, min(w, info.width - left)), np.nan)
    raw = zlib.decompress(raw) if info.packed else raw
    size = int(info.kind[1])
    lines = len(raw) // (w * samples * size)
    if info.predictor == 3:  # differences of bytes, the high bytes of a line first
        b = np.cumsum(np.frombuffer(raw, np.uint8)[: lines * w * samples * size].reshape(lines, size * w, samples), axis=1, dtype=np.uint8)
        v = np.ascontiguousarray(b.reshape(lines, size, w * samples).transpose(0, 2, 1)).view(">" + info.kind).reshape(lines, w, samples)
    else:
        v = np.frombuffer(raw, info.order + info.kind, lines * w * samples).reshape(lines, w, samples)
        if info.predictor == 2:
            whole = v.astype(f"=i{size}") if info.kind[0] != "f" else v.view(f"{info.order}i{size}").astype(f"=i{size}")
            v = np.cumsum(whole, axis=1, dtype=f"i{size}").view(f"={info.kind}")
    out = v[:rows, : info.width - left, 0 if info.planar else band - 1].astype(float)
    if info.nodata is not None:
        out[out == float(np.array(info.nodata, info.kind if info.kind[0] == "f" else float))] = np.nan
    return np.where(np.isfinite(out), out, np.nan)


def image(values: np.ndarray, x: float, y: float, dx: float, dy: float, tile: int = 256, nodata: float = -9999.0) -> bytes:
    """A file of doubles in packed tiles; (x, y) is the upper left corner, NaN is written as nodata."""
    if tile % 16:
        raise ValueError("tiles are multiples of 16 wide")
    h, w = values.shape
    filled = np.full((-(-h // tile) * tile, -(-w // tile) * tile), nodata)
    filled[:h, :w] = np.where(np.isfinite(values), values, nodata)
    packed = [zlib.compress(np.ascontiguousarray(filled[r : r + tile, c : c + tile], "<f8").tobytes()) for r in range(0, h, tile) for c in range(0, w, tile)]
    text = f"{nodata!r}\0".encode()
    tags = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (64,)), (COMPRESSION, 3, (DEFLATED[0],)), (SAMPLES, 3, (1,)), (TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILES, 4, [0] * len(packed)), (TILE_BYTES, 4, [len(p) for p in packed]),
            (NUMBERS, 3, (3,)), (SCALE, 12, (dx, dy, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, x, y, 0.0)), (NODATA, 2, text)]
    bodies = [t if k == 2 else struct.pack(f"<{len(t)}{TYPES[k]}", *t) for _, k, t in tags]
    start = 8 + 2 + 12 * len(tags) + 4
    places, at = [], start
    for body in bodies:
        places.append(at if len(body) > 4 else None)
        at += (len(body) + 1) // 2 * 2 if len(body) > 4 else 0
    starts = np.cumsum([at, *(len(p) for p in packed)])[:-1].tolist()
    bodies[7] = struct.pack(f"<{len(starts)}I", *starts)
    out = [b"II", struct.pack("<HIH", 42, 8, len(tags))]
    for (tag, kind, values_), body, place in zip(tags, bodies, places, strict=True):
        out.append(struct.pack("<HHI", tag, kind, len(values_)) + (body.ljust(4, b"\0") if place is None else struct.pack("<I", place)))
    out.append(b"\0" * 4)
    out += [body + b"\0" * (len(body) % 2) for body in bodies if len(body) > 4]
    return b"".join(out + packed)


@dataclass
class _Run(InputPartition):
    path: str
    first: int
    last: int


class _TileReader(DataSourceReader):
    def __init__(self, path: str, band: int, run: int):
        self.path, self.band, self.run = path, band, run

    def partitions(self) -> list[InputPartition]:
        store, _ = opened(self.path)
        runs = []
        for name in listed(self.path, ".tif", ".tiff"):
            with store.open_input_file(name) as file:
                told = layout(file.read_at)
            if not 1 <= self.band <= told.samples:
                raise ValueError(f"{name} has no band {self.band}")
            each = max(1, self.run // max(1, told.tile[0] * told.tile[1] * 8))
            runs += [_Run(name, i, min(i + each, told.count)) for i in range(0, told.count, each)]
        return runs

    def read(self, partition: _Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without partitions
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as file:
            told = layout(file.read_at)
            for tile in range(partition.first, partition.last):
                at = tile + (self.band - 1) * told.count * told.planar
                values = tile_values(told, tile, self.band, file.read_at(told.sizes[at], told.offsets[at]) if told.sizes[at] else b"")
                (dx, dy), (w, h) = told.step, told.tile
                x, y = told.corner[0] + tile % told.across * w * dx, told.corner[1] - tile // told.across * h * dy
                numbers = pa.array(values.ravel(), pa.float64(), from_pandas=True)
                row = [[partition.path], [tile], [x], [y], [dx], [dy], [values.shape[1]], [values.shape[0]], pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)]
                yield pa.record_batch([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


class _ImageWriter(FolderWriter):
    """A file for each row."""

    def __init__(self, path: str, overwrite: bool, tile: int):
        super().__init__(path, overwrite)
        self.tile = tile

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names = []
        for r in (r for batch in iterator for r in batch.to_pylist()):
            name, store, path = self.file(".tif")
            values = np.array(r["values"], float).reshape(r["height"], r["width"])
            with store.open_output_stream(path) as out:
                out.write(image(values, r["x"], r["y"], r["dx"], r["dy"], self.tile))
            names.append(name)
        return Written(names)


class RasterTiles(DataSource):
    """Tiles (file, tile, x, y, dx, dy, width, height, values) of a raster file, or of all .tif and .tiff files of a folder that the driver and the executors can open through Arrow.

    (x, y) is a tile's upper left corner, values go along rows, null where the raster says nothing. Options: band (1), bytes (unpacked bytes of a partition, 64 MB; a tile is never parted). Writing makes
    a file of each row, in a new folder, with tiles of the option `tile` (256); its rows' `file` and `tile` aren't kept.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TileReader(self.options["path"], int(self.options.get("band", 1)), int(self.options.get("bytes", 64 * 1024 * 1024)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ImageWriter(self.options["path"], overwrite, int(self.options.get("tile", 256)))
