"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Documents are cut into chunks. A chunk's postings are written bucket by bucket, as blocks (bucket, places of documents in the chunk, counts), and shuffled by
bucket, where the two corpora's totals meet and give the bucket's gain. What comes out of a bucket, (document, count * gain), is added up by chunk and
document. A chunk holds a bounded number of postings, a bucket any number of blocks, which are dealt over `salts` tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetworth.llm._common import save

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLOCKS = "chunk long, bucket int, place binary, number binary, total long, doc_place long, doc_id long, n_words long, n_features long"
_KNOWN = 1 << 20


class _Buckets(dict):
    """Bucket of a feature, remembered for the first 2**20 features of a task."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < _KNOWN:
            self[feature] = found
        return found


def _features(words: list[bytes], longest: int) -> Iterator[bytes]:
    """Runs of 1 to `longest` consecutive words."""
    yield from words
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def _chunk(name: int, docs: list[tuple[int | None, int]], features: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """The rows of one chunk: its documents (doc_id, words, features) in order of place, and its postings as a block for each bucket."""
    m = len(docs)
    place = np.repeat(np.arange(m, dtype=np.int64), [len(f) for f in features])
    keys, counts = np.unique(np.concatenate(features) * m + place, return_counts=True)
    bucket, place = keys // m, (keys % m).astype(np.int32)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts, len(bucket))[1:]
    totals = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0, np.int64)
    b = len(starts)
    # Places as differences: they are small numbers, which compress well.
    delta = np.diff(place, prepend=0)
    delta[starts] = place[starts]
    columns = {
        "chunk": pa.array([name] * (m + b), pa.int64()),
        "bucket": pa.array([None] * m + bucket[starts].tolist(), pa.int32()),
        "place": pa.array([None] * m + [delta[s:e].astype(np.int32).tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
        "number": pa.array([None] * m + [counts[s:e].astype(np.int32).tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
        "total": pa.array([None] * m + totals.tolist(), pa.int64()),
        "doc_place": pa.array([*range(m), *[None] * b], pa.int64()),
        "doc_id": pa.array([d for d, _ in docs] + [None] * b, pa.int64()),
        "n_words": pa.array([n for _, n in docs] + [None] * b, pa.int64()),
        "n_features": pa.array([len(f) for f in features] + [None] * b, pa.int64()),
    }
    return pa.record_batch(columns)


def _inverted(longest: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A retried task writes its whole output anew, so that names need only be unique among the tasks of one table.
        name = TaskContext.get().partitionId() << 32
        known, docs, features, held = _Buckets(buckets), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes().lower() if text.is_valid else b""
                words = _WORD.findall(raw)
                found = np.fromiter(map(known.__getitem__, _features(words, longest)), np.int64)
                docs.append((doc_id, len(words)))
                features.append(found)
                held += len(found) + 1
                if held >= most:
                    yield _chunk(name, docs, features, buckets)
                    name, docs, features, held = name + 1, [], [], 0
        if docs:
            yield _chunk(name, docs, features, buckets)

    return run


def inverted(docs: DataFrame, longest: int = 1, buckets: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """Saved rows of docs(doc_id, text): one for each document (bucket null) and one for each block of postings.

    A chunk is closed once it holds `most` features and documents, so that it never holds more than these and one document's.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_inverted(longest, buckets, most), _BLOCKS)
    return save(rows, "inverted")


def totals(postings: DataFrame) -> DataFrame:
    """bucket, total: at most one row for each bucket. Totals are added up before they are shuffled."""
    return postings.where("bucket is not null").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(own: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> DataFrame:
    """bucket, gain: floor(scale * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), the totals of both corpora met bucket by bucket."""
    both = totals(own).select("bucket", F.col("total").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(totals(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("total").alias("t")))
    both = save(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "totals")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(sums["all_s"] + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(sums["all_t"] + buckets)))
    return both.select("bucket", F.floor(scale * F.ln(ratio)).cast("long").alias("gain"))


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks (chunk, place, number, gain): the blocks with count * gain in place of counts."""
    for batch in batches:
        numbers = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        given = [(np.frombuffer(n, np.int32).astype(np.int64) * g).tobytes() for n, g in numbers]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(given, pa.binary())], names=["chunk", "place", "given"])


def _reduced(blocks: pa.Table) -> pa.Table:
    """The contributions to one chunk, added up by place. At most one block for each bucket, of a bounded number of postings in all."""
    places = [np.cumsum(np.frombuffer(p, np.int32), dtype=np.int64) for p in blocks.column("place").to_pylist()]
    given = [np.frombuffer(g, np.int64) for g in blocks.column("given").to_pylist()]
    at, value = np.concatenate(places), np.concatenate(given)
    weight = np.zeros(at.max() + 1, np.int64)
    np.add.at(weight, at, value)
    hit = np.unique(at)
    return pa.table({"chunk": pa.array([blocks.column("chunk")[0].as_py()] * len(hit), pa.int64()), "place": pa.array(hit, pa.int64()), "weight": pa.array(weight[hit], pa.int64())})


def weights(postings: DataFrame, gain: DataFrame, salts: int = 16) -> DataFrame:
    """chunk, place, weight: for each document with a feature, the sum of its features' gains.

    Blocks are shuffled by bucket and one of `salts` numbers and meet the bucket's gain there (at most buckets * salts rows).
    """
    blocks = postings.where("bucket is not null").select("chunk", "bucket", "place", "number").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))
    gain = gain.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = blocks.join(gain.hint("shuffle_hash"), ["bucket", "salt"]).select("chunk", "place", "number", "gain")
    emitted = met.mapInArrow(_emitted, "chunk long, place binary, given binary")
    return emitted.groupBy("chunk").applyInArrow(_reduced, "chunk long, place long, weight long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their partition and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.record_batch([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "part", "nth"])
        at += n


def ranked(scored: DataFrame, order: list[Column], keys: list[str], share: tuple[int, int]) -> DataFrame:
    """keys and rank, from 1 in the given order, of the first floor(share[0] * rows / share[1]) rows.

    Rows are dealt by range, numbered in each range, and the ranges' sizes (one row for each) added up.
    """
    kept = scored.select(*keys, *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    by = [F.col(f"_o{i}") for i in range(len(order))] + [F.col(k) for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", part int, nth long"
    rows = save(kept.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_numbered, schema), "ranked")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col("nth") + 1
    found = rows.join(F.broadcast(sizes), "part").where(rank <= F.floor(F.col("all") * share[0] / share[1]))
    return found.select(*keys, rank.cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, seed: int, longest: int = 1, buckets: int = 10_000, least_words: int = 20, share: tuple[int, int] = (10, 100)) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) of every row of docs(doc_id, text), for a draw without replacement that follows target(text).

    Features are runs of 1 to `longest` words, hashed into buckets; a document's weight is the sum of its features' gains. score adds Gumbel noise, fixed by
    seed and doc_id; of the rows with `least_words` words, the floor(share) of the highest scores are drawn and have a rank, ties to the smaller doc_id, then in any
    order.

    A null or empty text has no features: weight 0, never drawn if least_words is positive. A null doc_id counts as the empty text in the noise and
    comes last among ties. Repeated rows count each and are drawn each. Empty docs give no rows; an empty target leaves every gain to docs' own counts. Other
    columns are not read.
    """
    own = inverted(docs, longest, buckets)
    gain = save(gains(own, inverted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets), buckets), "gains")
    listed = own.where("bucket is null").select("chunk", F.col("doc_place").alias("place"), "doc_id", "n_words", "n_features")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0))).cast("long")
    scored = listed.join(weights(own, gain), ["chunk", "place"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    scored = save(scored.withColumn("score", F.col("weight") + noise), "scored")
    drawn = ranked(scored.where(F.col("n_words") >= least_words), [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id")], ["chunk", "place"], share)
    return scored.join(drawn, ["chunk", "place"], "left").select("doc_id", "n_features", "weight", "score", "rank")
