"""Binary map extracts: files of compressed blocks of nodes, ways and relations, read and written block by block.

    spark.dataSource.register(MapExtract)
    rows = spark.read.format("map_extract").option("kinds", "node,way").load("s3://bucket/region.osm.pbf")

The driver reads the blocks' headers only; tasks fetch and decode runs of whole blocks, into Arrow batches.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from streetworth.sources.folders import FolderWriter, Written, listed, opened

SCHEMA = "kind string, id bigint, lat double, lon double, refs array<bigint>, members array<struct<kind:string,ref:bigint,role:string>>, tags map<string,string>"
# Fixed values of the file format.
KINDS = ("node", "way", "relation")
UNDERSTOOD = {"OsmSchema-V0.6", "DenseNodes"}
MOST_HEADER, MOST_BLOCK, MOST_ELEMENTS = 64 * 1024, 32 * 1024 * 1024, 8000
GRANULARITY = 100

_MEMBER = pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(_MEMBER)), ("tags", pa.map_(pa.string(), pa.string()))])


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message; values of a length are bytes."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        if key & 7 == 0:
            value, at = _varint(buf, at)
        elif key & 7 == 2:
            size, at = _varint(buf, at)
            value, at = buf[at : at + size], at + size
            if at > len(buf):
                raise ValueError("a field is cut off")
        else:
            size = {1: 8, 5: 4}[key & 7]
            value, at = buf[at : at + size], at + size
        yield key >> 3, value


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _unpacked(buf: bytes) -> np.ndarray:
    """Packed varints as unsigned numbers."""
    b = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shifts = 7 * (np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1))
    return np.bitwise_or.reduceat((b[: ends[-1] + 1] & 127).astype(np.uint64) << shifts.astype(np.uint64), starts)


def _deltas(buf: bytes) -> np.ndarray:
    """Packed zigzag differences as the numbers that they add up to."""
    v = _unpacked(buf)
    return np.cumsum((v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64))


def _packed(values: np.ndarray) -> bytes:
    v = np.asarray(values, np.int64).astype(np.uint64)
    steps = np.arange(10, dtype=np.uint64) * np.uint64(7)
    groups = v[:, None] >> steps
    used = groups > 0
    used[:, 0] = True
    more = np.zeros_like(used)
    more[:, :-1] = used[:, 1:]
    return ((groups & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8) << 7)[used].tobytes()


def _one(value: int) -> bytes:
    """A single varint; arrays cost more than they spare on short lists."""
    value, out = value % (1 << 64), bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _short(values: list[int]) -> bytes:
    return b"".join(map(_one, values)) if len(values) < 64 else _packed(np.array(values))


def _zigzag(values) -> bytes:
    if len(values) < 64:
        steps = (b - a for a, b in zip([0, *values], values, strict=False))
        return b"".join(_one((s << 1) ^ (s >> 63)) for s in steps)
    d = np.diff(np.asarray(values, np.int64), prepend=0)
    return _packed((d << 1) ^ (d >> 63))


def _field(number: int, value: int | bytes) -> bytes:
    return _one(number << 3) + _one(value) if isinstance(value, int) else _one(number << 3 | 2) + _one(len(value)) + value


def _blocks(file: pa.NativeFile) -> Iterator[tuple[str, int, int]]:
    """(type, place, bytes) of each block of a file, from the headers alone."""
    size, at = file.size(), 0
    while at < size:
        length = int.from_bytes(file.read_at(4, at), "big")
        if not 0 < length <= MOST_HEADER or at + 4 + length > size:
            raise ValueError(f"no block header at byte {at}")
        header = dict(_fields(file.read_at(length, at + 4)))
        at += 4 + length
        if not 0 <= header[3] <= MOST_BLOCK or at + header[3] > size:
            raise ValueError(f"the block at byte {at} is cut off")
        yield header[1].decode(), at, header[3]
        at += header[3]


def _content(blob: bytes) -> bytes:
    for number, value in _fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
        if number == 4:
            return lzma.decompress(value)
        if number == 7:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(value, max_output_size=MOST_BLOCK)
        if number > 4:
            raise ValueError(f"blocks of compression {number} can't be read")
    raise ValueError("a block without content")


def _batch(kind: str, strings: pa.Array, ids: np.ndarray, tags: tuple, lat=None, lon=None, refs=None, members=None) -> pa.RecordBatch:
    """Columns of elements of one kind; tags are (numbers for each element, keys, values), refs and members (offsets, items)."""
    n = len(ids)
    none = lambda kind: pa.nulls(n, kind)
    offsets = pa.array(np.concatenate(([0], np.cumsum(tags[0]))).astype(np.int32))
    tagged = pa.MapArray.from_arrays(offsets, strings.take(pa.array(tags[1])), strings.take(pa.array(tags[2])))
    lists = [pa.ListArray.from_arrays(pa.array(np.asarray(c[0], np.int32)), c[1]) if c else none(_ARROW.field(name).type) for name, c in (("refs", refs), ("members", members))]
    placed = [pa.array(c) if c is not None else none(pa.float64()) for c in (lat, lon)]
    return pa.record_batch([pa.array([kind] * n, pa.string()), pa.array(np.asarray(ids, np.int64)), *placed, *lists, tagged], schema=_ARROW)


def _ends(marks: np.ndarray) -> np.ndarray:
    """Places of the zeros that end a node's tags, where values may be word 0 too: only a zero in place of a key ends them."""
    ends, at = [], 0
    while at < len(marks):
        if marks[at] == 0:
            ends.append(at)
        at += 1 if marks[at] == 0 else 2
    return np.array(ends, np.int64)


def _of_dense(dense: bytes, strings: pa.Array, place) -> pa.RecordBatch:
    parts = dict(_fields(dense))
    ids, lat, lon = (_deltas(parts.get(k, b"")) for k in (1, 8, 9))
    marks = _unpacked(parts.get(10, b"")).astype(np.int64)
    ends = np.flatnonzero(marks == 0)
    if len(ends) > len(ids):
        ends = _ends(marks)
    counts = (np.diff(ends, prepend=-1) - 1) // 2 if len(ends) else np.zeros(len(ids), np.int64)
    words = np.delete(marks, ends)
    return _batch("node", strings, ids, (counts, words[0::2], words[1::2]), *place(lat, lon))


def _column(buffers: list[bytes], deltas: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(numbers for each element, all numbers) of one packed field of many elements, unpacked at once; differences start again at each element."""
    joined = b"".join(buffers)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) < 128)
    to = np.searchsorted(ends, np.cumsum([len(b) for b in buffers]))
    counts = np.diff(to, prepend=0)
    if not deltas:
        return counts, _unpacked(joined).astype(np.int64)
    total = np.concatenate(([0], _deltas(joined)))
    return counts, total[1:] - np.repeat(total[to - counts], counts)


def _of_group(group: list[tuple[int, bytes]], number: int, strings: pa.Array, place) -> pa.RecordBatch:
    """Plain nodes (1), ways (3) or relations (4) of a group."""
    messages = [dict(_fields(v)) for n, v in group if n == number]
    zig = lambda v: (v >> 1) ^ -(v & 1)
    ids = np.array([zig(m[1]) if number == 1 else _signed(m[1]) for m in messages], np.int64)
    packed = lambda k, deltas=False: _column([m.get(k, b"") for m in messages], deltas)
    counts, keys = packed(2)
    tags = (counts, keys, packed(3)[1])
    if number == 1:
        return _batch("node", strings, ids, tags, *place(*(np.array([zig(m[k]) for m in messages]) for k in (8, 9))))
    counts, items = packed(8 if number == 3 else 9, True)
    offsets, refs = np.concatenate(([0], np.cumsum(counts))), pa.array(items)
    if number == 3:
        return _batch("way", strings, ids, tags, refs=(offsets, refs))
    member = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(packed(10)[1])), refs, strings.take(pa.array(packed(8)[1]))], fields=list(_MEMBER))
    return _batch("relation", strings, ids, tags, members=(offsets, member))


def decoded(raw: bytes, kinds: set[str]) -> Iterator[pa.RecordBatch]:
    """Elements of an uncompressed block, one batch for each kind of each group."""
    table, groups, granularity, origin = b"", [], GRANULARITY, [0, 0]
    for number, value in _fields(raw):
        if number == 1:
            table = value
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number in (19, 20):
            origin[number - 19] = _signed(value)
    strings = pa.array([s for _, s in _fields(table)], pa.binary()).cast(pa.string())
    place = lambda lat, lon: ((origin[0] + granularity * lat) / 1e9, (origin[1] + granularity * lon) / 1e9)
    for group in groups:
        fields = list(_fields(group))
        present = {n for n, _ in fields}
        if "node" in kinds:
            for _, dense in (f for f in fields if f[0] == 2):
                yield _of_dense(dense, strings, place)
        for number, kind in ((1, "node"), (3, "way"), (4, "relation")):
            if kind in kinds and number in present:
                yield _of_group(fields, number, strings, place)


def encoded(rows: list[dict]) -> bytes:
    """An uncompressed block of rows of the schema, one group for each kind; nodes are dense. Coordinates are rounded to 1e-7 degrees; null texts and null places are refused."""
    words: dict[str, int] = {}
    word = lambda text: words.setdefault(text, len(words) + 1)
    groups = []
    for kind in KINDS:
        some = [r for r in rows if r["kind"] == kind]
        if kind == "node" and some:
            marks = [n for r in some for n in [*(word(t) for pair in r["tags"] or () for t in pair), 0]]
            at = lambda c: np.round(np.array([r[c] for r in some], float) * 1e9 / GRANULARITY).astype(np.int64)  # noqa: B023, E731
            if not np.isfinite(np.array([(r["lat"], r["lon"]) for r in some], float)).all():
                raise ValueError("a node without a place")
            dense = _field(1, _zigzag([r["id"] for r in some])) + _field(8, _zigzag(at("lat"))) + _field(9, _zigzag(at("lon")))
            groups.append(_field(2, dense + (_field(10, _packed(np.array(marks))) if len(marks) > len(some) else b"")))
            continue
        out = []
        for r in some:
            tags = r["tags"] or []
            body = _field(1, r["id"]) + b"".join(_field(k + 2, _short([word(pair[k]) for pair in tags])) for k in (0, 1) if tags)
            if kind == "way":
                body += _field(8, _zigzag(r["refs"] or []))
            else:
                m = r["members"] or []
                body += _field(8, _short([word(x["role"]) for x in m])) + _field(9, _zigzag([x["ref"] for x in m])) + _field(10, _short([KINDS.index(x["kind"]) for x in m]))
            out.append(_field(3 if kind == "way" else 4, body))
        if out:
            groups.append(b"".join(out))
    if None in words or any(r["kind"] not in KINDS for r in rows):
        raise ValueError("a null text, or an unknown kind")
    return _field(1, b"".join(_field(1, w.encode()) for w in ("", *words))) + b"".join(_field(2, g) for g in groups)


def framed(kind: str, raw: bytes) -> bytes:
    """A block as it stands in a file."""
    if len(raw) > MOST_BLOCK:
        raise ValueError(f"a block of {len(raw)} bytes")
    blob = _field(2, len(raw)) + _field(3, zlib.compress(raw))
    header = _field(1, kind.encode()) + _field(3, len(blob))
    return len(header).to_bytes(4, "big") + header + blob


def file_header() -> bytes:
    return framed("OSMHeader", b"".join(_field(4, f.encode()) for f in sorted(UNDERSTOOD)))


@dataclass
class _Run(InputPartition):
    path: str
    blocks: list[tuple[int, int]]


class _ExtractReader(DataSourceReader):
    def __init__(self, path: str, kinds: set[str], run: int):
        self.path, self.kinds, self.run = path, kinds, run

    def partitions(self) -> list[InputPartition]:
        store, _ = opened(self.path)
        runs = []
        for name in listed(self.path, ".pbf"):
            blocks, held = [], 0
            with store.open_input_file(name) as file:
                for kind, at, size in _blocks(file):
                    if kind == "OSMHeader":
                        needed = {v.decode() for n, v in _fields(_content(file.read_at(size, at))) if n == 4}
                        if needed - UNDERSTOOD:
                            raise ValueError(f"{name} needs {sorted(needed - UNDERSTOOD)}")
                    elif kind == "OSMData":
                        if blocks and held + size > self.run:
                            runs.append(_Run(name, blocks))
                            blocks, held = [], 0
                        blocks.append((at, size))
                        held += size
            if blocks:
                runs.append(_Run(name, blocks))
        return runs

    def read(self, partition: _Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without partitions
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as file:
            for at, size in partition.blocks:
                yield from decoded(_content(file.read_at(size, at)), self.kinds)


class _ExtractWriter(FolderWriter):
    """A file for each task that has rows."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, waiting, out = [], [], None
        try:
            for batch in iterator:
                waiting += batch.to_pylist()
                if waiting and out is None:
                    name, store, path = self.file(".pbf")
                    names.append(name)
                    out = store.open_output_stream(path)
                    out.write(file_header())
                while len(waiting) >= MOST_ELEMENTS:
                    out.write(framed("OSMData", encoded(waiting[:MOST_ELEMENTS])))
                    waiting = waiting[MOST_ELEMENTS:]
            if waiting:
                out.write(framed("OSMData", encoded(waiting)))
        finally:
            if out is not None:
                out.close()
        return Written(names)


class MapExtract(DataSource):
    """Elements (kind, id, lat, lon, refs, members, tags) of a binary map extract, or of all .pbf files of a folder that the driver and the executors can open through Arrow.

    Options: kinds (node,way,relation: other elements are not decoded), bytes (compressed bytes of a partition, 64 MB; a block is never parted). Elements without tags have an empty map; refs are
    null but in ways, members but in relations, places but in nodes. A file that needs a feature other than those understood, or that is cut off, is refused. Writing needs a new folder.
    """

    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kinds = {k.strip() for k in self.options.get("kinds", ",".join(KINDS)).split(",")}
        if kinds - set(KINDS):
            raise ValueError(f"unknown kinds {sorted(kinds - set(KINDS))}")
        return _ExtractReader(self.options["path"], kinds, int(self.options.get("bytes", 64 * 1024 * 1024)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ExtractWriter(self.options["path"], overwrite)
