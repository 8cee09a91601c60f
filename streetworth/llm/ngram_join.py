"""N-gram Jaccard join: a blocked sparse product of documents by word shingles.

Every text becomes the set of its distinct five-word shingles. Equal sets form one class, so that copies are never paired. Of each class only the
first n - ceil(0.75 n) + 1 shingles in one global order (rare before frequent) enter the product. The product runs in blocks of shingles; a block gives
groups of classes that share a shingle, equal groups once with their number of shingles. Within a group, all are held against one hub first; after
linking these, only pairs whose components still differ are multiplied out, and their shared shingles added up over the groups.

Size-derived bounds: a pair of sizes n <= m can only reach the threshold if 100 n >= 75 m and the overlap is at least o = ceil(75 (n + m) / 175). Beyond
the shorter of the two prefixes at most ceil(0.75 m) - 1 shingles can be shared, so that o - ceil(0.75 m) + 1 must be shared within the prefixes; pairs
below are discarded. The rest is decided by exact overlap counts of whole sets. A pair is left out only when it can't reach the threshold or its two
classes are already known to be connected, so components are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streetworth.llm import _text as T
from streetworth.llm._common import components, input_blocks, maybe_in, save

_CHUNKS = 16


def _sets(batches, k: int):
    """For each slice: its rows, and each row's sorted distinct shingle hashes."""
    for rows, data, offsets in T.slices(batches):
        hashes, begins = T.shingles(*T.word_hashes(data, offsets), k)
        yield rows, hashes, [T.distinct(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _measure(k: int, bits: int):
    """Map side of the first pass: a row (id, set_id, n) for each text, and chunks of the partition's table of shingle loads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(1 << bits, np.int32)
        schema = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("second_id", pa.int64()), ("n", pa.int64()), ("chunk", pa.int32()), ("loads", pa.binary())])
        for rows, hashes, sets in _sets(batches, k):
            np.add.at(loads, hashes >> np.uint64(64 - bits), 1)
            m = len(sets)
            ids = [T.digests(s) if len(s) else (None, None) for s in sets]
            yield pa.record_batch([rows.column(0), *(pa.array([i[h] for i in ids], pa.int64()) for h in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(loads, _CHUNKS)]
        if loads.any():
            yield pa.record_batch([pa.nulls(_CHUNKS, pa.int64())] * 4 + [pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _own_id(s: np.ndarray, clashing: frozenset[int]) -> int:
    """The id of a set: half of its 128-bit digest, the other half where another set of the corpus has the first one too."""
    first, second = T.digests(s)
    return second if first in clashing else first


def _set_ids(k: int):
    """Rows with both halves of the digest of their text's set, as _measure gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, sets in _sets(batches, k):
            ids = [T.digests(s) if len(s) else (None, None) for s in sets]
            halves = [pa.array([i[h] for i in ids], pa.int64()) for h in (0, 1)]
            yield pa.record_batch([*(rows.column(i) for i in range(rows.num_columns)), *halves], names=[*rows.schema.names, "set_id", "second_id"])

    return run


def with_set_id(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs(..., text) with set_id and second_id, the halves of a 128-bit digest: equal for texts of equal shingles and null for those without words."""
    return docs.mapInArrow(_set_ids(k), StructType([*docs.schema.fields]).add("set_id", "long").add("second_id", "long"))


def _add_loads(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.int64(0)
    for x in pdf["loads"]:
        total = total + np.frombuffer(zlib.decompress(x), np.int32)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "loads": [zlib.compress(total.tobytes(), 1)]})


def _load_classes(first: DataFrame, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of 2**bits hash ranges: its load beyond what chance gives, in doublings (0 to 15), and into how many parts a shingle there is dealt.

    The table has 2**bits entries whatever the input; it only sets an order, so its coarseness costs time and never a link.
    """
    rows = first.where("chunk is not null").select("chunk", "loads").groupBy("chunk").applyInPandas(_add_loads, "chunk int, loads binary").collect()
    if not rows:
        return np.zeros(1 << bits, np.uint8), np.ones(1 << bits, np.uint16)
    loads = np.concatenate([np.frombuffer(zlib.decompress(r["loads"]), np.int64) for r in sorted(rows, key=lambda r: r["chunk"])])
    mean = loads.mean()
    chance = 2 * np.sqrt(mean) + 2
    classes = np.clip(np.floor(np.log2(np.maximum(loads - mean, 1) / chance)) + 1, 0, 15).astype(np.uint8)
    return classes, np.minimum(1 + loads // hot, 65535).astype(np.uint16)


def _incidences(k: int, percent: int, bits: int, shared, blocks: int, clashing: frozenset[int]):
    """Map side of the second pass: each class's prefix of shingles, dealt into blocks; a class once for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, parts = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, ids, places = (np.concatenate(x) for x in zip(*held, strict=True))
            split = parts[(keys << np.uint64(4)) >> np.uint64(64 - bits)]
            dealt = (T.mix(keys) % np.uint64(blocks)).astype(np.int64) + blocks * (ids.view(np.uint64) % split.astype(np.uint64)).astype(np.int64)
            order = np.argsort(dealt, kind="stable")
            keys, ids, places, dealt = keys[order], ids[order], places[order], dealt[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(dealt)) + 1, [len(dealt)]))
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pa.record_batch({"block": pa.array(dealt[cuts[:-1]], pa.int64()), "keys": pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()), "ids": pa.array([ids[a:b].tobytes() for a, b in pairs], pa.binary()), "places": pa.array([places[a:b].tobytes() for a, b in pairs], pa.binary())})

        for _, _, sets in _sets(batches, k):
            for s in sets:
                if not len(s) or (own := _own_id(s, clashing)) in seen:
                    continue
                seen.add(own)
                keys = np.sort((s >> np.uint64(4)) | (classes[s >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(60)))
                keys = keys[: len(s) + (-percent * len(s)) // 100 + 1]
                held.append((keys, np.full(len(keys), own, np.int64), np.minimum(np.arange(len(keys)), 65535).astype(np.uint16)))
                size += len(keys)
            if size > 400_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _groups(bits: int, shared):
    """One block of the product: which classes meet in a shingle. Rows (gid, id, w, place): the digest of the group, or the shingle where it is dealt in parts; w shingles, the first of them at this place in the class's order (or behind it)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        T.release()
        parts = shared.value[1]
        keys, ids, places = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("keys", np.uint64), ("ids", np.int64), ("places", np.uint16)))
        order = np.lexsort((ids, keys))
        keys, ids, places = keys[order], ids[order], places[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        keys, ids, places = keys[new], ids[new], places[new]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((begins, [len(keys)])))
        dealt = parts[(keys[begins] << np.uint64(4)) >> np.uint64(64 - bits)] > 1
        digest = np.where(dealt, keys[begins], T.mix(np.add.reduceat(T.mix(ids.view(np.uint64)), begins) + sizes.astype(np.uint64)))
        keep = np.flatnonzero(dealt | (sizes > 1))
        if not len(keep):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("gid", "id", "w", "place")})
        at = np.repeat(begins[keep] - np.concatenate(([0], np.cumsum(sizes[keep])[:-1])), sizes[keep]) + np.arange(sizes[keep].sum())
        rows = pd.DataFrame({"gid": np.repeat(digest[keep], sizes[keep]).view(np.int64), "id": ids[at], "place": places[at].astype(np.int64)})
        return rows.groupby(["gid", "id"], as_index=False).agg(w=("place", "size"), place=("place", "min"))[["gid", "id", "w", "place"]]

    return run


def _packed(k: int, clashing: frozenset[int]):
    """The texts of classes: their sets, 64 bits for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, sets in _sets(batches, k):
            want = rows.column(rows.schema.get_field_index("id")).to_pylist()
            got = [(w, s.tobytes()) for w, s in zip(want, sets, strict=True) if len(s) and _own_id(s, clashing) == w]
            yield pa.record_batch({"id": pa.array([g[0] for g in got], pa.int64()), "packed": pa.array([g[1] for g in got], pa.binary())})

    return run


def _decide(percent: int):
    """Pairs with both sets: those that reach the threshold, with the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release()
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i in range(len(a)):
                both = np.sort(np.frombuffer(x[i] + y[i], np.uint64))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    out.append((a[i], b[i], shared))
            yield pa.record_batch({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()), "shared": pa.array([o[2] for o in out], pa.int64())})
        T.release()

    return run


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 75, load_bits: int = 22, hot: int = 2_000_000) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, set_id, second_id, root) for each row of docs(doc_id, text); root is the smallest id of a set in the component.

    Two texts link when their Jaccard similarity is at least percent / 100. Null and empty texts have no shingles and their own doc_id as component;
    equal rows and equal doc_ids stay separate rows. Other columns are not read. A shingle whose range of hashes has over `hot` occurrences is dealt
    over several tasks. load_bits sets the size of the broadcast order, 3 bytes for each of 2**load_bits ranges; raise it with the corpus, to 26 for
    hundreds of billions of words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    blocks = input_blocks(docs)
    first = save(docs.mapInArrow(_measure(k, load_bits), "doc_id long, set_id long, second_id long, n long, chunk int, loads binary"), "sets")
    shared = spark.sparkContext.broadcast(_load_classes(first, load_bits, hot))
    texts = first.where("chunk is null").withColumn("id", F.col("set_id"))

    def classes() -> DataFrame:
        second = [F.min("second_id").alias("least"), F.max("second_id").alias("most")]
        return save(texts.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *second), "classes")

    reps = classes()
    # of n different sets about n * n / 2**65 share half a digest: none below a few thousand millions
    clashing = frozenset(r["id"] for r in reps.where("least <> most").select("id").collect())
    if clashing:
        texts = texts.withColumn("id", F.when(F.col("id").isin(*clashing), F.col("second_id")).otherwise(F.col("id")))
        reps = classes()

    dealt = docs.mapInArrow(_incidences(k, percent, load_bits, shared, blocks, clashing), "block long, keys binary, ids binary, places binary")
    groups = dealt.groupBy("block").applyInPandas(_groups(load_bits, shared), "gid long, id long, w long, place long")
    groups = save(groups.groupBy("gid", "id").agg(F.sum("w").alias("w"), F.min("place").alias("place")), "groups")

    members = groups.groupBy("gid").agg(F.count("*").alias("members")).where("members > 1")
    met = groups.join(members, "gid").groupBy("id").agg(F.sum(F.col("w") * F.col("members")).alias("met"), F.array_sort(F.collect_list(F.struct("gid", "w"))).alias("groups"))
    met = save(met.join(reps.select("id", "n"), "id").withColumn("centre", F.col("met") / F.col("n")), "met")
    sized = groups.join(met.select("id", "n", "centre"), "id")
    sides = [met.select(F.col("id").alias(i), F.col("n").alias(n), F.col("groups").alias(f"groups_{i}")) for i, n in (("a", "n"), ("b", "m"))]
    overlap = f"ceil({percent} * (n + m) / {100 + percent})"
    # a pair's first shared shingle leaves room for the overlap on both sides
    fits = F.expr(f"id <> b and 100 * least(n, m) >= {percent} * greatest(n, m) and place <= n - {overlap} and place_b <= m - {overlap}")

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that share enough shingles within their prefixes."""
        pairs = pairs.join(sides[0], "a").join(sides[1], "b")
        shared = F.aggregate(F.map_values(F.map_zip_with(F.map_from_entries("groups_a"), F.map_from_entries("groups_b"), lambda g, x, y: F.when(x.isNotNull() & y.isNotNull(), x).otherwise(0))), F.lit(0).cast("long"), lambda x, y: x + y)
        return pairs.where(shared >= F.expr(f"{overlap} - ceil({percent} * greatest(n, m) / 100) + 1")).select("a", "b")

    # all against the most central and the smallest of their group: near copies of one text mostly link with that text itself
    hub = F.struct("id", "n", "place")
    hubs = sized.groupBy("gid").agg(F.min(hub).alias("low"), F.max_by(hub, F.struct("centre", "id")).alias("high"))
    hubs = hubs.select("gid", F.explode(F.array_distinct(F.array("low", "high"))).alias("hub")).select("gid", F.col("hub.id").alias("b"), F.col("hub.n").alias("m"), F.col("hub.place").alias("place_b"))
    stars = sized.join(hubs, "gid").where(fits).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    stars = save(bounded(stars), "stars")

    def decide(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose whole sets reach the threshold. Only texts of these pairs are shuffled."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = save(reps.join(ends, "id").select("doc_id", "id"), "wanted")
        near = maybe_in(docs, wanted, "doc_id").where("_maybe").drop("_maybe")
        packed = save(near.join(wanted, "doc_id").select("id", "text").mapInArrow(_packed(k, clashing), "id long, packed binary"), "packed")
        left = packed.select(F.col("id").alias("a"), F.col("packed").alias("x"))
        right = packed.select(F.col("id").alias("b"), F.col("packed").alias("y"))
        return save(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_decide(percent), "a long, b long, shared long").distinct(), name)

    links = decide(stars, "links")
    found = save(components(links), "found")

    # pairs that are not known to be connected
    labelled = sized.join(found, "id", "left").select("gid", "id", "n", "place", F.coalesce("component", "id").alias("label"))
    open_ids = labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gid")
    rest = save(labelled.join(open_ids, "gid"), "open")
    # the larger set of a pair is in the size class of the smaller one or in the next, so a crowded group is multiplied out class by class
    size_class = F.floor(F.log("n") / float(np.log(100 / percent)))
    larger = rest.select("gid", size_class.alias("size"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("place").alias("place_b"), F.col("label").alias("label_b"))
    smaller = rest.withColumn("size", F.explode(F.array(size_class, size_class + 1)))
    pairs = smaller.join(larger, ["gid", "size"]).where("label <> label_b and (n < m or (n = m and id < b))").where(fits)
    pairs = pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    more = decide(save(bounded(pairs.join(stars, ["a", "b"], "left_anti")), "pairs"), "links")
    found = components(links.unionByName(more))

    ids = reps.join(found, "id", "left").withColumn("root", F.coalesce("component", "id"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(least, "root").select("id", "component_id", "root")
    return texts.join(ids, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "second_id", "root")
