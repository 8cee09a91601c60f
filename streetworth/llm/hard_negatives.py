"""Hard-negative mining by dual-tree search.

Candidates are cut into parts of one label, consecutive in an order along their principal directions; anchors into blocks. Inside, both are halved into trees whose
nodes are balls. The inner products of two balls lie within [c*c' - s, c*c' + s] with s = r|c'| + r'|c| + rr', so a pair of nodes is dropped for all its anchors
at once where that interval misses what every one of them still looks for; pairs of leaves are scored exactly. A task holds one block of anchors, with what each
has found, and parts of the candidates stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetworth.llm._common import input_blocks, save
from streetworth.llm.importance import ranked
from streetworth.llm.vectors import _exact, _numbers, _turns, _vectors

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BALLS = 4096


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable rows (vec_id, label, anchor, dim, raw) with floor(256 * x), as 32-bit numbers where they fit."""
    for batch in batches:
        ids, _, labels, anchors = (c.to_pylist() if i != 1 else None for i, c in enumerate(batch.columns))
        rows = zip(ids, labels, anchors, _vectors(batch.column(1)), strict=True)
        kept = [(i, label, bool(anchor), np.floor(v * 256)) for i, label, anchor, v in rows if i is not None and label is not None and v is not None]
        raws = [(w.astype(np.int32) if np.abs(w).max() < 2**31 else w).tobytes() for *_, w in kept]
        columns = [pa.array([r[0] for r in kept], pa.int64()), pa.array([r[1] for r in kept], pa.string()), pa.array([r[2] for r in kept], pa.bool_())]
        yield pa.record_batch([*columns, pa.array([len(r[3]) for r in kept], pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "label", "anchor", "dim", "raw"])


def _coded(shared):
    """The place of each vector on a space-filling curve through the cells of its direction, in up to eight principal directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws = np.array(batch.column("dim").to_pylist(), int), batch.column("raw").to_pylist()
            code = np.zeros(len(dims), np.int64)
            for d in set(dims.tolist()):
                mine = np.flatnonzero(dims == d)
                x = _numbers([raws[i] for i in mine], d)
                x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1)
                y = (x @ shared.value[d][:, :8]) / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
                cell = np.clip((y + 1) * 32, 0, 63).astype(np.int64)
                for bit in range(5, -1, -1):
                    for j in range(cell.shape[1]):
                        code[mine] = code[mine] << 1 | cell[:, j] >> bit & 1
            yield pa.record_batch([*batch.columns, pa.array(code, pa.int64())], names=[*batch.schema.names, "code"])

    return run


class Tree:
    """Balls over rows of x, halved down to at most `leaf` rows; `order` is the rows in the order of the leaves."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        starts, ends, children, centres, radii = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            rows = x[self.order[a:b]]
            centre = rows.mean(0)
            if parent >= 0:
                children[parent].append(len(starts))
            starts.append(a)
            ends.append(b)
            children.append([])
            centres.append(centre)
            radii.append(np.sqrt(((rows - centre) ** 2).sum(1).max()))
            if b - a > leaf:
                axis, middle = np.argmax(rows.var(0)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], middle)]
                todo += [(a + middle, b, len(starts) - 1), (a, a + middle, len(starts) - 1)]
        self.start, self.end = np.array(starts), np.array(ends)
        self.children = np.array([c or [-1, -1] for c in children])
        self.leaf = self.children[:, 0] < 0
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.x = x[self.order]
        self.largest = float(np.abs(x).max(initial=0))


def interval(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between the rows of nodes i of a and j of b."""
    middle = np.einsum("ij,ij->i", a.centre[i], b.centre[j])
    spread = a.radius[i] * b.norm[j] + b.radius[j] * a.norm[i] + a.radius[i] * b.radius[j]
    slack = spread * (1 + 1e-9) + 1e-9 * a.norm[i] * b.norm[j] + 1
    return middle - slack, middle + slack


def _extreme(tree: Tree, values: np.ndarray, of) -> np.ndarray:
    """of(values) over each node's rows."""
    out = np.empty(len(tree.start), values.dtype)
    for n in range(len(out) - 1, -1, -1):
        # Children come after their parents.
        out[n] = of(values[tree.start[n] : tree.end[n]]) if tree.leaf[n] else of(out[tree.children[n]])
    return out


def leaf_pairs(a: Tree, b: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose interval of inner products meets [low, high] of a's node; low and high are given for each row of a, in the order of its leaves."""
    low, high = _extreme(a, low, np.min).astype(float), _extreme(a, high, np.max).astype(float)
    i = j = np.zeros(1, int)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(i):
        least, most = interval(a, i, b, j)
        meets = (most >= low[i]) & (least <= high[i])
        i, j = i[meets], j[meets]
        done = a.leaf[i] & b.leaf[j]
        found.append((i[done], j[done]))
        i, j = i[~done], j[~done]
        # Halve the wider node of each pair, or the one that can be halved.
        first = ~a.leaf[i] & (b.leaf[j] | (a.radius[i] * np.maximum(b.norm[j], 1) >= b.radius[j] * np.maximum(a.norm[i], 1)))
        i, j = (np.concatenate((np.repeat(i[~first], 2), a.children[i[first]].ravel())), np.concatenate((b.children[j[~first]].ravel(), np.repeat(j[first], 2))))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Block:
    """Anchors, their ranges of scores [low, high], and the k best rows found so far in each range."""

    def __init__(self, ids: np.ndarray, labels: list[str], x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, leaf: int):
        self.tree, self.k = Tree(x, leaf), k
        order = self.tree.order
        self.ids, self.labels = ids[order], np.array(labels, object)[order]
        # `reach`: the least score that would still change an anchor's result.
        self.low, self.high, self.reach = low[order], high[order], low[order].copy()
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)

    def meet(self, ids: np.ndarray, label: str, x: np.ndarray, leaf: int, same: bool) -> None:
        """Score a part of the candidates, all of one label, against anchors of the same or of other labels."""
        usable = (self.labels == label) == same
        if not usable.any() or not self.low.shape[1]:
            return
        tree, part = self.tree, Tree(x, leaf)
        ids = ids[part.order]
        empty = ~(usable[:, None] & (self.reach <= self.high))
        low = np.where(empty, _HIGH, self.reach).min(1)
        high = np.where(empty, _LOW, self.high).max(1)
        i, j = leaf_pairs(tree, part, low, high)
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
        news = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            rows = np.arange(tree.start[i[s]], tree.end[i[s]])
            columns = np.concatenate([np.arange(part.start[n], part.end[n]) for n in j[s:e]])
            news.append(self._scored(rows, columns, ids, part, low, high))
        self._merge(*(np.concatenate(c) for c in zip(*news, strict=True))) if news else None

    def _scored(self, rows, columns, ids, part, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor * ranges + range, score, id) of what may be among the k best of a range."""
        a, x = self.tree.x[rows], part.x[columns]
        size = self.tree.largest * part.largest * x.shape[1]
        slack = 0.0 if size < 2**53 else 1 + 1e-9 * size
        scores = a @ x.T
        other = self.ids[rows][:, None] != ids[columns][None, :]
        out = []
        wide = (scores >= low[rows].astype(float)[:, None] - slack) & (scores <= high[rows].astype(float)[:, None] + slack) & other
        few = wide.sum() <= 8 * self.k * len(rows)
        for r in range(self.low.shape[1]):
            reach, top = self.reach[rows, r], self.high[rows, r]
            if few:
                u, v = np.nonzero(wide)
            else:
                held = wide & (scores >= reach.astype(float)[:, None] - slack) & (scores <= top.astype(float)[:, None] + slack)
                # Within these rows' own k best only, with all ties.
                if len(columns) > self.k:
                    kth = np.partition(np.where(held, scores, -np.inf), -self.k, axis=1)[:, -self.k]
                    held &= scores >= kth[:, None] - 2 * slack
                u, v = np.nonzero(held)
            exact = scores[u, v].astype(np.int64) if not slack else np.concatenate([_exact(a[u[p : p + 10_000]], x[v[p : p + 10_000]]) for p in range(0, len(u), 10_000)] or [np.zeros(0, np.int64)])
            keep = (exact >= reach[u]) & (exact <= top[u])
            out.append((rows[u[keep]] * self.low.shape[1] + r, exact[keep], ids[columns[v[keep]]]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _merge(self, *new: np.ndarray) -> None:
        at, score, ids = (np.concatenate((o, n)) for o, n in zip(self.found, new, strict=True))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        last = nth == self.k - 1
        flat = self.reach.reshape(-1)
        flat[at[last]] = np.maximum(flat[at[last]], score[last])
        self.found = tuple(c[nth < self.k] for c in (at, score, ids))


_FOUND = "anchor_id long, place int, vec_id long, score long"


def _streamed(k: int, same: bool, leaf: int):
    """Partitions sorted by (block, slice, parts after anchors): each block with the parts that follow its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, blocks = None, [], None

        def ready() -> dict[int, Block]:
            made = {}
            for d in {a[2] for a in anchors}:
                own = [a for a in anchors if a[2] == d]
                ids, labels = np.array([a[0] for a in own], np.int64), [a[1] for a in own]
                width = max(len(a[4]) for a in own)
                # Missing ranges are empty ones.
                low = np.array([[*a[4], *[_HIGH] * (width - len(a[4]))] for a in own], np.int64).reshape(len(own), width)
                high = np.array([[*a[5], *[_LOW] * (width - len(a[5]))] for a in own], np.int64).reshape(len(own), width)
                made[d] = Block(ids, labels, _numbers([a[3] for a in own], d), low, high, k, leaf)
            return made

        def told() -> Iterator[pa.RecordBatch]:
            for block in (blocks or {}).values():
                at, score, ids = block.found
                width = block.low.shape[1]
                yield pa.record_batch({"anchor_id": pa.array(block.ids[at // max(width, 1)], pa.int64()), "place": pa.array(at % max(width, 1), pa.int32()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "slice", "ids", "vec_id", "label", "dim", "raw", "low", "high")), strict=True):
                if row[:2] != key:
                    yield from told()
                    key, anchors, blocks = row[:2], [], None
                ids, vec_id, label, dim, raw, low, high = row[2:]
                if ids is None:
                    anchors.append((vec_id, label, dim, raw, low, high))
                    continue
                if blocks is None:
                    blocks = ready()
                    anchors = []
                if dim in blocks:
                    cids = np.frombuffer(ids, np.int64)
                    width = len(raw) // len(cids)
                    blocks[dim].meet(cids, label, _numbers([raw[i : i + width] for i in range(0, len(raw), width)], dim), leaf, same)
        yield from told()

    return run


def _parts(size: int, most: int):
    """Consecutive candidates of one label, dimension and width as one row with the ball around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            x = _numbers([h[3] for h in held], held[0][1])
            centre = x.mean(0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
            row = {"part": (held[0][2], pa.int64()), "label": (held[0][0], pa.string()), "dim": (held[0][1], pa.int32()), "ids": (np.array([h[2] for h in held], np.int64).tobytes(), pa.binary()), "raw": (b"".join(h[3] for h in held), pa.binary()), "centre": (centre.tolist(), pa.list_(pa.float64())), "radius": (radius, pa.float64())}
            return pa.record_batch({c: pa.array([v], t) for c, (v, t) in row.items()})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "vec_id", "raw")), strict=True):
                full = held and (len(held) >= size or len(held) * len(row[3]) >= most)
                if held and (full or held[-1][:2] != row[:2] or len(held[-1][3]) != len(row[3])):
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    return run


def _ball(rows: pa.Table) -> pa.Table:
    """The ball around some anchors of one dimension, the scores that they look for, and their blocks."""
    d = rows.column("dim")[0].as_py()
    x = _numbers(rows.column("raw").to_pylist(), d)
    centre = x.mean(0)
    low = [v for r in rows.column("low").to_pylist() for v in r]
    high = [v for r in rows.column("high").to_pylist() for v in r]
    blocks = rows.column("block").to_pylist()
    out = {"dim": pa.array([d], pa.int32()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [float(np.sqrt(((x - centre) ** 2).sum(1).max()))]}
    return pa.table(out | {"low": pa.array([min(low, default=_HIGH)], pa.int64()), "high": pa.array([max(high, default=_LOW)], pa.int64()), "first": pa.array([min(blocks)], pa.int64()), "last": pa.array([max(blocks)], pa.int64())})


def _hit(shared):
    """With each part, the blocks of anchors of which some ball may have what it looks for in that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for dim, centre, radius in zip(*(batch.column(c).to_pylist() for c in ("dim", "centre", "radius")), strict=True):
                hit: set[int] = set()
                if dim in shared.value:
                    c, r, low, high, first, last = shared.value[dim]
                    p = np.array(centre)
                    norms, norm = np.sqrt((c * c).sum(1)), np.sqrt(p @ p)
                    spread = (r * norm + radius * norms + r * radius) * (1 + 1e-9) + 1e-9 * norm * norms + 1
                    middle = c @ p
                    for n in np.flatnonzero((middle + spread >= low) & (middle - spread <= high)):
                        hit.update(range(first[n], last[n] + 1))
                blocks.append(sorted(hit))
            yield pa.record_batch([*batch.columns, pa.array(blocks, pa.list_(pa.int64()))], names=[*batch.schema.names, "blocks"])

    return run


_PART = "part long, label string, dim int, ids binary, raw binary, centre array<double>, radius double"


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100), anchor_mb: int = 16, part_rows: int = 1024, leaf: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of vectors(vec_id, embedding, label) that is_anchor selects.

    Scores are inner products of floor(256 * x); higher ones come first, ties by smaller vec_id. An anchor's positives are its first rows of the same label,
    itself excluded; for each, the negatives are the first rows of other labels with percent[0] * positive <= 100 * negative <= percent[1] * positive.

    Rows with a null vec_id or label, and vectors that are null, empty or hold null or non-finite components take no part; vectors of another dimension are not
    compared. Labels are of any type that can be written as text. Scores beyond 64 bits are held at the ends of that range. vec_id is a key: rows
    of a repeated one are candidates each but not for each other, and equal anchor rows count once. An anchor without positives, or a positive without negatives, has no
    rows; an empty table gives none. Other columns are not read.

    A task's memory is a block of anchors (about anchor_mb megabytes as 32-bit numbers) and one part of candidates. A part is sent once to each block that it may concern.
    """
    sc = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = save(rows.mapInArrow(_whole, "vec_id long, label string, anchor boolean, dim int, raw binary"), "vectors")
    turns, _ = _turns(whole.select("vec_id", "dim", "raw"))
    coded = whole.mapInArrow(_coded(sc.broadcast(turns)), "vec_id long, label string, anchor boolean, dim int, raw binary, code long")
    order = ["label", "dim", F.length("raw"), "code", "vec_id"]
    parts = save(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_parts(part_rows, 1 << 22), _PART), "parts")

    anchors = coded.where("anchor").dropDuplicates(["vec_id", "label", "dim", "raw"]).withColumn("size", F.length("raw"))
    anchors = save(anchors, "anchors")
    n, size = anchors.agg(F.count("*"), F.sum("size")).first()
    per = max(1, (anchor_mb << 20) * n // max(size or 1, 1))
    place = ranked(anchors, [F.col("label"), F.col("dim"), F.col("code")], ["vec_id", "dim", "label", "raw"], (1, 1)).withColumnRenamed("rank", "nth")
    anchors = save(place.withColumn("nth", F.col("nth") - 1).withColumn("block", F.floor(F.col("nth") / per)), "placed")
    blocks = max(1, -(-n // per))
    slices = max(1, input_blocks(vectors) // blocks)

    def search(asking: DataFrame, met: DataFrame, k: int, same: bool) -> DataFrame:
        """asking(block, vec_id, label, dim, raw, low, high) against met(block and the columns of parts): the k best rows in each range."""
        none = {c: F.lit(None).cast(t) for c, t in (("ids", "binary"), ("vec_id", "long"), ("low", "array<long>"), ("high", "array<long>"))}
        held = asking.withColumn("ids", none["ids"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("part", F.lit(None).cast("long"))
        sent = met.withColumns({c: none[c] for c in ("vec_id", "low", "high")}).withColumn("slice", F.pmod(F.xxhash64("part"), F.lit(slices)).cast("int"))
        columns = ["block", "slice", "ids", "vec_id", "label", "dim", "raw", "low", "high", "part"]
        both = held.select(columns).unionByName(sent.select(columns))
        dealt = both.repartition(slices * blocks, "block", "slice").sortWithinPartitions("block", "slice", F.col("ids").isNotNull(), "part")
        found = save(dealt.mapInArrow(_streamed(k, same, leaf), _FOUND), "found")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    everything = anchors.withColumns({"low": F.array(F.lit(_LOW)), "high": F.array(F.lit(_HIGH))})
    own = parts.join(anchors.select("label", "dim", "block").distinct(), ["label", "dim"])
    best = search(everything, own, positives, True)
    least = F.transform("scores", lambda s: _percent(s, percent[0], up=True))
    most = F.transform("scores", lambda s: _percent(s, percent[1], up=False))
    known = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    known = known.select(F.col("anchor_id").alias("vec_id"), F.col("found.vec_id").alias("positive_ids"), F.col("found.score").alias("scores"))
    known = save(known.withColumns({"low": least, "high": most}), "positives")
    asking = anchors.join(known.select("vec_id", "low", "high"), "vec_id")

    # At most 4096 balls over all anchors (and one more for each dimension) say which blocks a part may concern.
    balls = asking.withColumn("ball", F.floor(F.col("nth") * _BALLS / max(n, _BALLS))).groupBy("ball", "dim").applyInArrow(_ball, "dim int, centre array<double>, radius double, low long, high long, first long, last long")
    by_dim: dict[int, list] = {}
    for b in balls.collect():
        by_dim.setdefault(b["dim"], []).append(b)
    arrays = {d: tuple(np.array([b[c] for b in found]) for c in ("centre", "radius", "low", "high", "first", "last")) for d, found in by_dim.items()}
    hit = parts.mapInArrow(_hit(sc.broadcast(arrays)), _PART + ", blocks array<bigint>").withColumn("block", F.explode("blocks"))
    mined = search(asking, hit, negatives, False)
    given = known.select(F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("positive_ids", "scores")).alias("place", "p"))
    out = mined.join(given, ["anchor_id", "place"])
    return out.select("anchor_id", F.col("p.positive_ids").alias("positive_id"), F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), F.col("p.scores").alias("positive_score"), F.col("score").alias("negative_score"))


def _percent(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100, rounded up or down, exact for all 64-bit scores and held in their range."""
    exact = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")
    whole = F.ceil(exact) if up else F.floor(exact)
    return F.least(F.greatest(whole.cast("decimal(38,0)"), F.lit(_LOW).cast("decimal(38,0)")), F.lit(_HIGH).cast("decimal(38,0)")).cast("long")
