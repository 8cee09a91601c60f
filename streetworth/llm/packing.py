"""Best-fit packing of tokenized documents into sequences.

Best-fit decreasing with a segment tree over remaining capacities: for each document, longest first, the tightest open sequence is found in logarithmic
time. Documents of one length are interchangeable, so the tree is walked once for each run of equal documents rather than for each document: it needs
only the histogram of lengths (at most `capacity` numbers, whatever the corpus) and returns runs that say into which sequences the documents of
rank r..s of a length go. Ranks are dealt out over the cluster, so that no task holds all documents of a frequent length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetworth.llm import _text as T
from streetworth.llm._common import input_blocks, save

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)  # ASCII marks, but for the apostrophe, which takes part in contractions
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True
_coders: dict[str, Coder] = {}


#: Texts on which a vocabulary's tokens by word are held against those of the whole text.
_PROBES = [
    "The Quick brown fox's tail, isn't it? (Yes!) \"No...\" - e.g. 3.14, 1,000 and 50%; a_b c-d x@y.org http://a.b/c?d=e&f#g",
    "two  spaces,\ttabs\n\nand lines\r\n  indented\x0b end  ",
    "Größe ÉCOLE façade naïve ŒUVRE Łódź - ß's don't WE'LL they've I'D",
    "CamelCase HTTPServer x2y 2nd v1.0.0-rc.1 #tag $5 <b>bold</b> {a: [1, 2]} a&&b||c !!! ??? ...",
    "''quoted'' 'single' \"double\" `code` it''s o'clock 'tis",
]


class Coder:
    """Token ids of words, kept in a hash table of numpy arrays: keys are 64-bit hashes of words in lower case, values are slices of one array of ids.

    This vocabulary's tokens never cross white space, do not depend on case, and keep a letter and a run of marks behind it apart. So the ids of a text are
    those of its words one after the other, a word's trailing marks being a word of their own. Where that is not certain (signs beyond U+027F, other white
    space, a dotted capital I, what may be a special token), a text goes through the tokenizer whole. When the table is half full, it starts again.

    Whether a vocabulary is of that kind is tried on _PROBES when it is loaded; where it is not, every text goes through the tokenizer whole.
    """

    def __init__(self, path: str, bits: int = 21):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mask = np.uint64((1 << bits) - 1)
        self.clear()
        self.by_word = True
        raws = [p.encode() for p in _PROBES]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
        got = self.encode(np.frombuffer(b"".join(raws), np.uint8), offsets)
        self.by_word = all(x == self._whole(p) for x, p in zip(got, _PROBES, strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def clear(self) -> None:
        size = int(self.mask) + 1
        self.keys, self.begin, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.ids, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the hashes, -1 where a hash is not kept."""
        slots = np.full(len(hashes), -1, np.int64)
        todo, at = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(todo):
            keys = self.keys[at]
            hit = keys == hashes[todo]
            slots[todo[hit]] = at[hit]
            more = ~hit & (keys != 0)
            todo, at = todo[more], (at[more] + 1) & int(self.mask)
        return slots

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        flat, counts = array("I"), []
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            flat.extend(e.ids)
            counts.append(len(e.ids))
        new = np.array(flat, np.uint32)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used : self.used + len(new)] = new
        count = np.array(counts, np.int64)
        begin = self.used + np.cumsum(count) - count
        self.used, self.words = self.used + len(new), self.words + len(words)
        todo, at = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot], self.begin[slot], self.count[slot] = hashes[todo[won]], begin[todo[won]], count[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & int(self.mask)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if self.words > int(self.mask) // 2:
            self.clear()
        before = np.concatenate(([0], data[:-1])).astype(np.uint8)
        odd = (data >= 0xCA) | ((before == 0xC2) & ((data == 0x85) | (data == 0xA0))) | ((before == 0xC4) & (data == 0xB0)) | ((before == 60) & (data == 124))
        strange = np.diff(np.concatenate(([0], np.cumsum(odd)))[offsets]) > (0 if self.by_word else -1)
        low = np.where((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(32), T.LOWER[data])
        starts, ends, _ = T.words(data, offsets)
        cut = ends.copy()
        for _ in range(8):
            cut -= (cut - 1 > starts) & _MARK[data[cut - 1]]
        apart = (cut < ends) & _LETTER[data[cut - 1]]
        begins = np.sort(np.concatenate((starts, cut[apart])), kind="stable")
        finish = np.sort(np.concatenate((np.where(apart, cut, ends), ends[apart])), kind="stable")
        firsts = np.searchsorted(begins, offsets)
        hashes = T.hash_ranges(low, begins, finish) | np.uint64(1)
        text = np.repeat(np.arange(len(strange)), np.diff(firsts))
        hashes[strange[text]] = 0
        slots = self.find(hashes)
        missing = np.flatnonzero((slots < 0) & (hashes != 0))
        raw = data.tobytes()
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self.learn(new, [raw[a:b].decode() for a, b in zip(begins[at].tolist(), finish[at].tolist(), strict=True)])
            slots[missing] = self.find(hashes[missing])
        slots[hashes == 0] = 0
        count = np.where(hashes == 0, 0, self.count[slots]).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(self.begin[slots] - total[:-1], count) + np.arange(total[-1])].astype("<u4").tobytes()
        cuts = (4 * total[firsts]).tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(strange):
            out[i] = self._whole(raw[offsets[i] : offsets[i + 1]].decode())
        return out


def coder(path: str) -> Coder:
    """This worker's coder of a vocabulary."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = int(end_id).to_bytes(4, "little")
        for batch, data, offsets in T.slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder(path).encode(data, offsets), strict=True):
                ids += mark
                for j, i in enumerate(range(0, len(ids), 4 * capacity)):
                    rows.append((doc, j, i // 4, len(ids[i : i + 4 * capacity]) // 4, zlib.crc32(ids[i : i + 4 * capacity])))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Capacities:
    """A segment tree over remaining capacities 0..most: which of them some open sequence has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, at: int, there: bool) -> None:
        at += self.size
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least`."""
        at = least + self.size
        while not self.any[at]:
            while at & 1:  # a right child: go up
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, documents in each sequence, first sequence, offset): documents of this length from this rank on fill sequences one after the other."""
    tree, open_, runs, made = Capacities(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            open_.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, new = capacity, -(-left // (capacity // length))
                put(room, made, new)
                made += new
            first, n = open_[room].pop()
            if not open_[room]:
                tree.put(room, False)
            each = room // length  # a sequence that just got one is the tightest as long as another fits
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - room))
                put(room - each * length, first, full)
            rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:  # fewer than `each`
                runs.append((length, rank, left, first, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return runs


def _placed(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ranks, each, firsts, offsets = shared.value
        for f in frames:
            at = np.searchsorted(keys, (f["length"].to_numpy() << 48) + f["rank"].to_numpy(), "right") - 1
            place = f["rank"].to_numpy() - ranks[at]
            yield f.drop(columns="rank").assign(sequence_id=firsts[at] + place // each[at], offset=offsets[at] + place % each[at] * f["length"].to_numpy())

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then end_id (a null text: only this). Only documents over `capacity` are cut. Every piece gets a place in one sequence,
    gapless from 0. Repeated rows are packed each; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = input_blocks(docs)
    pieces = save(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(best_fit_runs(histogram, capacity))
    length, rank, each, first, offset = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else [[]] * 5))
    shared = spark.sparkContext.broadcast(((length << 48) + rank, rank, each, first, offset))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    return ranked.mapInPandas(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
