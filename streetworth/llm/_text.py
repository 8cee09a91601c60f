"""Words, shingles and hashes of whole texts, computed over Arrow buffers with numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give free memory back to the system: a worker that waits for its next task should not hold the last one's arrays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches so that the texts of a slice have about `limit` bytes (one longer text stands alone): the rows, their UTF-8 bytes and offsets. Null: empty."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
        del batch, text, raw, ends
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base to the powers 0..n-1, modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        grown = np.full(max(n, 1 << 16), base, U64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        if n > 8 << 20:  # of one very long text; not kept
            return grown[:n]
        _powers[base] = grown
    return _powers[base][:n]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside`, which never cross an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    starts[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: differences of polynomial prefix sums."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
    unshift = powers(len(data) + 1, _BASE_INVERSE)
    return mix((sums[ends] - sums[starts]) * unshift[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and where each text's words begin among them."""
    starts, ends = spans_of(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z in lower case, and where each text's words begin."""
    starts, ends, firsts = words(data, offsets)
    return hash_ranges(LOWER[data], starts, ends), firsts


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles (of the whole sequence where a text has 1 to k-1 words), repeats included, and where each text's begin."""
    n = np.diff(firsts)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begins = np.concatenate(([0], np.cumsum(made)))
    text = np.repeat(np.arange(len(n)), made)
    at = np.arange(begins[-1]) - begins[:-1][text] + firsts[:-1][text]
    size = np.minimum(n, k)[text]
    padded = np.concatenate((hashes, np.zeros(k, U64)))
    total = size.astype(U64) * U64(0x2545F4914F6CDD1D)
    short = size < k
    for j in range(k):
        part = padded[at + j] * U64(_PLACES[j % 8]) + U64(j)
        if j and short.any():
            part[short & (j >= size)] = 0
        total += part
    return mix(total), begins


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def digests(x: np.ndarray) -> tuple[int, int]:
    """The halves of a 128-bit digest of an array's bytes, as signed numbers."""
    found = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)
