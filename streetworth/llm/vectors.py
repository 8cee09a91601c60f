"""Embeddings: near-duplicate links by an epsilon grid order join, and exact top-k search by inner product."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetworth.llm._common import components, input_blocks, save

GRID = 4


def _vectors(column: pa.Array) -> list[tuple[int, np.ndarray | None]]:
    """Vectors as float64; None where the vector is null, empty or holds null or non-finite components."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid or not len(x.values) or x.values.null_count:
            out.append(None)
        else:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out.append(v if np.isfinite(v).all() else None)
    return out


# ---- near duplicates ----


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column(0), batch.column(2).to_pylist()
        keys, raws, dims = [], [], []
        for v, label in zip(_vectors(batch.column(1)), labels, strict=True):
            usable = v is not None and label is not None and v.any()
            raw = (v + 0.0).tobytes() if usable else None
            raws.append(raw)
            dims.append(len(v) if usable else None)
            keys.append(hashlib.blake2b(f"{label}:".encode() + raw, digest_size=16).digest() if usable else None)
        yield pa.record_batch([ids, pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "dim", "key", "raw"])


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims, raws = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
        for d in set(dims.tolist()):
            u = _unit([r for r, e in zip(raws, dims.tolist(), strict=True) if e == d])
            sums[d] = sums.get(d, 0) + np.concatenate(([len(u)], u.sum(0), (u.T @ u).ravel()))
    yield pa.record_batch({"dim": pa.array(list(sums), pa.int32()), "value": pa.array(list(sums.values()), pa.list_(pa.float64()))})


def _principal(reps: DataFrame, grid: int) -> dict[int, np.ndarray]:
    """For each dimension d, the leading directions [d, grid] of the unit vectors; the driver gets d * d numbers, summed by Spark."""
    parts = reps.select("dim", "raw").mapInArrow(_second_moments, "dim int, value array<double>")
    parts = parts.select("dim", F.posexplode("value").alias("i", "v")).groupBy("dim", "i").agg(F.sum("v").alias("v"))
    sums: dict[int, dict[int, float]] = {}
    for r in parts.collect():
        sums.setdefault(r["dim"], {})[r["i"]] = r["v"]
    out = {}
    for d, s in sums.items():
        flat = np.array([s[i] for i in range(1 + d + d * d)])
        mean = flat[1 : d + 1] / flat[0]
        _, vectors = np.linalg.eigh(flat[d + 1 :].reshape(d, d) / flat[0] - np.outer(mean, mean))
        directions = vectors[:, ::-1][:, :grid]
        out[d] = np.pad(directions, ((0, 0), (0, grid - directions.shape[1])))
    return out


def _cells(shared, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws = batch.column(batch.schema.get_field_index("dim")).to_pylist(), batch.column(batch.schema.get_field_index("raw")).to_pylist()
            cells = [np.floor(_unit([r])[0] @ shared.value[d] / epsilon).astype(int).tolist() for d, r in zip(dims, raws, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


_BLOCK = "block string, label string, dim int, n int, low array<double>, high array<double>, ids binary, weights binary, raw binary"


def _intervals(shared, size: int):
    """Consecutive vectors of one label and dimension in grid order become sequence intervals of at most `size`, with their bounds in the principal directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            y = _unit([h[4] for h in held]) @ shared.value[held[0][1]]
            ids, weights = np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64)
            name = hashlib.blake2b(ids.tobytes(), digest_size=12).hexdigest()
            row = {"block": [name], "label": [held[0][0]], "dim": [held[0][1]], "n": [len(held)], "low": [y.min(0).tolist()], "high": [y.max(0).tolist()], "ids": [ids.tobytes()], "weights": [weights.tobytes()], "raw": [b"".join(h[4] for h in held)]}
            return pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(row.items(), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()), strict=True)})

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "dim", "id", "copies", "raw")), strict=True):
                if held and (len(held) == size or held[-1][:2] != row[:2]):
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    return run


def _far(a_low, a_high, b_low, b_high, epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(a_low - b_high, b_low - a_high))
    return float((gap * gap).sum()) > epsilon * epsilon


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the links of two sides connect."""
    rows, columns, edges = np.zeros(links.shape[0], bool), np.zeros(links.shape[1], bool), []
    for start in np.flatnonzero(links.any(1)).tolist():
        if rows[start]:
            continue
        rows[start] = True
        queue = [(True, start)]
        while queue:
            is_row, i = queue.pop()
            new = np.flatnonzero(links[i] & ~columns) if is_row else np.flatnonzero(links[:, i] & ~rows)
            (columns if is_row else rows)[new] = True
            for j in new.tolist():
                edges.append((i, j) if is_row else (j, i))
                queue.append((not is_row, j))
    return edges


def _joined(shared, cosine: float, epsilon: float, leaf: int = 64):
    """Join two sequence intervals: halve both until they are small or provably farther apart than epsilon, then compare exactly. Rows (a, null, links) and (a, b, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["block_a"] == r["block_b"]
                u, v = (np.frombuffer(r[f"raw_{s}"], np.float64).reshape(r[f"n_{s}"], -1) for s in "ab")
                u, v = (x / np.abs(x).max(1, keepdims=True) for x in (u, v))
                u, v = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (u, v))
                p, q = (x @ shared.value[r["dim"]] for x in (u, v))
                links = np.zeros((len(u), len(v)), bool)
                todo = [(0, len(u), 0, len(v))]
                while todo:
                    a, b, c, d = todo.pop()
                    if _far(p[a:b].min(0), p[a:b].max(0), q[c:d].min(0), q[c:d].max(0), epsilon):
                        continue
                    if max(b - a, d - c) <= leaf:
                        links[a:b, c:d] = u[a:b] @ v[c:d].T >= cosine
                    else:
                        left = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > leaf else [(a, b)]
                        right = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > leaf else [(c, d)]
                        todo += [(*x, *y) for x in left for y in right if not same or x[0] < y[1]]
                if same:
                    links = np.triu(links, 1)
                ids_a, ids_b = (np.frombuffer(r[f"ids_{s}"], np.int64) for s in "ab")
                w_a, w_b = (np.frombuffer(r[f"weights_{s}"], np.int64) for s in "ab")
                to_a, to_b = links.astype(np.int64) @ w_b, w_a @ links.astype(np.int64)
                some_a, some_b = np.flatnonzero(to_a), np.flatnonzero(to_b)
                edges = _forest(links | links.T if same else links)
                one = [*ids_a[some_a].tolist(), *ids_b[some_b].tolist(), *(int(ids_a[i]) for i, _ in edges)]
                two = [None] * (len(some_a) + len(some_b)) + [int(ids_b[j]) for _, j in edges]
                number = [*to_a[some_a].tolist(), *to_b[some_b].tolist(), *[None] * len(edges)]
                yield pa.record_batch({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64()), "links": pa.array(number, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, size: int = 512) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label).

    Two vectors link when their labels are equal and not null and their cosine, in double precision, is at least `cosine`. Vectors that are null, empty or
    zero or hold null or non-finite components, and those without a label, link with nothing. Equal vectors of a label are compared once and counted as
    often as they occur. Labels are of any type that can be written as text, and equal where that is. vec_id is a key; other columns are not read; an empty table gives no rows.
    """
    sc = vectors.sparkSession.sparkContext
    epsilon = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    parsed = save(vectors.select("vec_id", "embedding", F.col("label").cast("string")).mapInArrow(_parsed, "vec_id long, label string, dim int, key binary, raw binary"), "vectors")
    reps = parsed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    reps = save(reps, "reps")
    shared = sc.broadcast(_principal(reps, GRID))
    order = ["label", "dim", *(F.col("cells")[i] for i in range(GRID)), "id"]
    sorted_ = reps.mapInArrow(_cells(shared, epsilon), "key binary, id long, copies long, label string, dim int, raw binary, cells array<int>").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = save(sorted_.mapInArrow(_intervals(shared, size), _BLOCK), "intervals")

    bounds = blocks.select("block", "label", "dim", "low", "high").withColumns({"c": F.floor(F.col("low")[0] / epsilon), "e": F.floor(F.col("high")[0] / epsilon)})
    left = bounds.select(F.col("block").alias("block_a"), "label", "dim", F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence("c", "e")).alias("cell"))
    right = bounds.select(F.col("block").alias("block_b"), "label", "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(F.col("c") - 1, F.col("e") + 1)).alias("cell"))
    gap = [F.greatest(F.lit(0.0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i]) for i in range(GRID)]
    near = left.join(right, ["label", "dim", "cell"]).where("block_a <= block_b").where(sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= epsilon * epsilon)
    near = near.select("block_a", "block_b", "dim").distinct()

    def side(s: str) -> DataFrame:
        return blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "n", "ids", "weights", "raw")))

    found = save(near.join(side("a"), "block_a").join(side("b"), "block_b").mapInArrow(_joined(shared, cosine, epsilon), "a long, b long, links long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    told = reps.select("key", "id", "copies").join(counts, "id", "left").join(roots, "id", "left")
    told = told.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = parsed.select("vec_id", "key").join(told, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


# ---- exact top-k ----


def levels(d: int) -> list[int]:
    """How many leading components are segments of their own at each level, coarse to fine; the others form two segments."""
    return [m for m in sorted({d // 8, d // 2, 3 * d // 4, 7 * d // 8}) if m and d - m >= 2]


def tail_segments(y: np.ndarray, m: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of the two segments behind the first m components, side by side.

    For two vectors, the products of these and of the m leading components (segments of one, without deviation) sum to at least their inner product: that of
    the means plus, by Cauchy and Schwarz, at most that of the deviations. It is the bound |x - y|**2 >= sum of length * ((mean - mean')**2 +
    (deviation - deviation')**2), solved for the inner product.
    """
    parts = np.array_split(y[:, m:], 2, axis=1)
    means = np.stack([p.mean(1) * np.sqrt(p.shape[1]) for p in parts], 1)
    deviations = np.stack([p.std(1) * np.sqrt(p.shape[1]) for p in parts], 1)
    return np.concatenate((means, deviations), 1)


def surviving(q: np.ndarray, x: np.ndarray, least: np.ndarray, other: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Pairs (row of q, row of x) of rotated vectors whose upper bound of the inner product reaches the query's `least` at every level, and the share of pairs alive after each.

    `other` says which pairs count at all. Bounds of a level are products of the components that it adds to the last one; once few pairs are alive, only theirs.
    """
    alive, sums, at, shares = other.copy(), np.zeros((len(q), len(x))), 0, []
    i = j = p = None
    for m in levels(q.shape[1]):
        tq, tx = tail_segments(q, m), tail_segments(x, m)
        if i is None:
            sums += q[:, at:m] @ x[:, at:m].T
            alive &= ~(sums + tq @ tx.T + slack < least[:, None])
            shares.append(float(alive.mean()))
            if shares[-1] < 0.05:
                i, j = np.nonzero(alive)
                p = sums[i, j]
        else:
            keep = np.zeros(len(i), bool)
            for a in range(0, len(i), 100_000):
                u, v = i[a : a + 100_000], j[a : a + 100_000]
                p[a : a + 100_000] += np.einsum("ij,ij->i", q[u, at:m], x[v, at:m])
                keep[a : a + 100_000] = ~(p[a : a + 100_000] + np.einsum("ij,ij->i", tq[u], tx[v]) + slack < least[u])
            i, j, p = i[keep], j[keep], p[keep]
            shares.append(len(i) / alive.size)
        at = m
    return (*(np.nonzero(alive) if i is None else (i, j)), shares)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact where they fit 53 bits, else by whole numbers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)


_LOWEST = np.iinfo(np.int64).min


def search(qids: np.ndarray, q: np.ndarray, xids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int, least: np.ndarray, rows: int = 2048, first: int = 256) -> tuple[np.ndarray, ...]:
    """(query row, vec_id, score) of each query's best k among x, and each query's k-th score (or `least`, a score that it is known to reach, where that is more).

    Without a score to reach, `first` candidates are scored exactly to have one; all others are held against bounds, and only survivors are scored.
    """
    least = least.copy()
    out: list[tuple] = []
    for a in range(0, len(q), rows):
        ids, own, reach = qids[a : a + rows], q[a : a + rows], least[a : a + rows]
        turned = own @ turn
        best_row, best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = list(range(0, len(x), rows))
        if len(x) > first and (reach == _LOWEST).any():
            cuts = [0, *range(first, len(x), rows)]
        for c, e in pairwise([*cuts, len(x)]):
            cand, cids = x[c:e], xids[c:e]
            slack = 1 + 1e-9 * np.abs(own).max(initial=0) * np.abs(cand).max(initial=0) * own.shape[1]
            i, j, _ = surviving(turned, cand @ turn, reach.astype(float), ids[:, None] != cids[None, :], slack)
            scores = np.concatenate([_exact(own[i[b : b + 100_000]], cand[j[b : b + 100_000]]) for b in range(0, len(i), 100_000)] or [np.zeros(0, np.int64)])
            best_row, best_id, best = np.concatenate((best_row, i)), np.concatenate((best_id, cids[j])), np.concatenate((best, scores))
            order = np.lexsort((best_id, -best, best_row))
            best_row, best_id, best = best_row[order], best_id[order], best[order]
            nth = np.arange(len(best)) - np.searchsorted(best_row, best_row)
            reach[best_row[nth == k - 1]] = np.maximum(reach[best_row[nth == k - 1]], best[nth == k - 1])
            take = nth < k
            best_row, best_id, best = best_row[take], best_id[take], best[take]
        keep = best >= reach[best_row]
        out.append((best_row[keep] + a, best_id[keep], best[keep]))
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), least)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (vec_id, dim, raw) of floor(256 * x), as 32-bit numbers where they fit."""
    for batch in batches:
        found = [(i, np.floor(v * 256)) for i, v in zip(batch.column(0).to_pylist(), _vectors(batch.column(1)), strict=True) if v is not None and i is not None]
        raws = [(w.astype(np.int32) if np.abs(w).max() < 2**31 else w).tobytes() for _, w in found]
        yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([len(w) for _, w in found], pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "raw"])


def _numbers(raws: list[bytes], d: int) -> np.ndarray:
    return np.array([np.frombuffer(r, np.int32 if len(r) == 4 * d else np.float64) for r in raws], np.float64).reshape(len(raws), d)


def _energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each dimension of the partition: the vectors, and the sums of products of their components at unit length."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims, raws = np.array(batch.column(1).to_pylist(), int), batch.column(2).to_pylist()
        for d in set(dims.tolist()):
            w = _numbers([r for r, e in zip(raws, dims.tolist(), strict=True) if e == d], d)
            u = w[w.any(1)]
            u = u / np.abs(u).max(1, keepdims=True)
            u = u / np.sqrt((u * u).sum(1, keepdims=True))
            sums[d] = sums.get(d, 0) + np.concatenate(([len(w)], (u.T @ u).ravel()))
    yield pa.record_batch({"dim": pa.array(list(sums), pa.int32()), "value": pa.array(list(sums.values()), pa.list_(pa.float64()))})


def _turns(whole: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """For each dimension the orthogonal matrix to its principal directions, and the bytes of all vectors. The driver gets d * d numbers for each dimension d."""
    parts = whole.mapInArrow(_energies, "dim int, value array<double>")
    parts = parts.select("dim", F.posexplode("value").alias("i", "v")).groupBy("dim", "i").agg(F.sum("v").alias("v"))
    sums: dict[int, dict[int, float]] = {}
    for r in parts.collect():
        sums.setdefault(r["dim"], {})[r["i"]] = r["v"]
    turns = {d: np.linalg.eigh(np.array([s[i] for i in range(1, 1 + d * d)]).reshape(d, d))[1][:, ::-1].copy() for d, s in sums.items()}
    return turns, int(sum(4 * d * s[0] for d, s in sums.items()))


_FOUND = "query_id long, vec_id long, score long, least long, dim int, raw binary"


def _met(shared, k: int, keep_queries: bool):
    """A block of queries (vec_id, dim, raw, least) against a part of the candidates. Rows of found neighbours, and with keep_queries the queries with the score to reach."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = {c: [] for c in ("query_id", "vec_id", "score", "least", "dim", "raw")}
        cdims, qdims = (np.array(t.column("dim").to_pylist(), int) for t in (candidates, queries))
        for d in sorted(set(qdims.tolist())):
            mine, own = np.flatnonzero(qdims == d), np.flatnonzero(cdims == d)
            qids, least = (np.array(queries.column(c).take(mine).to_pylist(), np.int64) for c in ("vec_id", "least"))
            raws = queries.column("raw").take(mine).to_pylist()
            q, x = _numbers(raws, d), _numbers(candidates.column("raw").take(own).to_pylist(), d)
            row, ids, scores, least = search(qids, q, np.array(candidates.column("vec_id").take(own).to_pylist(), np.int64), x, shared.value[d], k, least)
            more = len(qids) if keep_queries else 0
            for c, values in (("query_id", qids[row].tolist()), ("vec_id", ids.tolist()), ("score", scores.tolist()), ("least", [None] * len(row)), ("dim", [d] * len(row)), ("raw", [None] * len(row))):
                out[c] += values
            for c, values in (("query_id", qids.tolist()), ("vec_id", [None] * more), ("score", [None] * more), ("least", least.tolist()), ("dim", [d] * more), ("raw", raws)):
                out[c] += values[:more]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, query_mb: int = 32, part_mb: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query selects, the k other vectors of the highest inner product of floor(256 * x), ties to the smaller vec_id.

    Blocks of at most about query_mb megabytes of queries meet parts of at most about part_mb of candidates; the first part of the candidates gives every query
    a score to reach in the others. Vectors that are null, empty or hold null or non-finite components take no part; vectors of another dimension are not
    compared; scores beyond 64 bits are held at the ends of that range. vec_id is a key: a repeated one is no candidate for itself, and its rows are all
    queries or candidates. Other columns are not read; an empty table, or no query, gives no rows.
    """
    sc = vectors.sparkSession.sparkContext
    vectors = vectors.select("vec_id", "embedding")
    whole = vectors.mapInArrow(_whole, "vec_id long, dim int, raw binary")
    turns, size = _turns(whole)
    shared = sc.broadcast(turns)
    queries = save(vectors.where(is_query).mapInArrow(_whole, "vec_id long, dim int, raw binary"), "queries")
    blocks = 1 + (queries.agg(F.sum(F.length("raw"))).first()[0] or 0) // (query_mb << 20)
    parts = max(input_blocks(vectors), size // (part_mb << 20) + 1)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    candidates = whole.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(parts)).cast("int"))
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks - 1)))))

    def against(own: DataFrame, chosen: DataFrame, keep_queries: bool) -> DataFrame:
        return chosen.groupBy("block", "part").cogroup(own.groupBy("block", "part")).applyInArrow(_met(shared, k, keep_queries), _FOUND)

    first = queries.select("vec_id", "dim", "raw", "block", F.lit(0).alias("part"), F.lit(_LOWEST).alias("least"))
    first = save(against(first, candidates.where("part = 0"), True), "first")
    again = first.where("vec_id is null").select(F.col("query_id").alias("vec_id"), "dim", "raw", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "least")
    again = again.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(int(parts - 1)))))
    found = first.where("vec_id is not null") if parts == 1 else first.where("vec_id is not null").unionByName(against(again, candidates.where("part > 0"), False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
