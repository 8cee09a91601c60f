"""Suffix-array dedup: removal of every byte inside a 400-byte string that starts anywhere else too.

Suffixes are sorted where it matters: each 400-byte window has one anchor, the position in it whose 100-byte gram has the smallest hash (the leftmost of
equals), so equal windows have their anchors at equal places. An anchor's context (the windows that it answers for) is a suffix from the anchor on and a
reversed prefix before it. Anchors whose gram occurs once are done with. The others are sorted into front-coded runs, the runs are exchanged by gram, and
each reducer combines its runs with a loser tree that carries common prefixes and never compares known characters again. The merged order with its common
prefixes, and the order of the reversed prefixes, say exactly which windows repeat; hashes only choose what is compared.

A gram that occurs very often would fill one task. Its contexts are grouped by keys that grow instead: for a range of distances from window start to anchor,
the bytes that all windows of the range have (the inner key) tell apart contexts that can't share a window, and the bytes that any of them has (the
outer key) tell which contexts share all. What neither settles is halved, down to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetworth.llm import _text as T
from streetworth.llm._common import input_blocks, save

_PLACE = 32  # bits of a position inside a slice (Spark's strings end below 2**31 bytes); the other 32 are the gram's order
_OFTEN = 8


def _text_id(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _is(text_id: int, raw: bytes) -> bool:
    """Whether a row's text_id is that of the text: the first eight bytes of its digest, or the next where two texts of the corpus agree in those."""
    sha = hashlib.sha256(raw).digest()
    return text_id in (_text_id(sha), _text_id(sha[8:]))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i with a whole window: prefix minima from the right and the left of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all windows of `length` bytes inside one text: anchor, first and last window start of each run of windows with one anchor, and the anchor's gram hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * T.powers(len(data)), out=sums[1:])
    hashes = T.mix((sums[gram:] - sums[:-gram]) * T.powers(len(data) + 1, T._BASE_INVERSE)[: len(data) - gram + 1])
    order = ((hashes >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_min(order, length - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    inside = np.zeros(len(least) + 1, np.int64)
    whole = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    owner = least[starts]
    if not len(owner):
        return none, none, none, none.view(np.uint64)
    new = np.concatenate(([True], owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(owner)])) - 1
    return owner[first], starts[first], starts[last], hashes[owner[first]]


def _first_pass(length: int, gram: int, blocks: int):
    """A row (doc_id, text_id, n_bytes, sha) for each text; anchors of texts new to the partition, dealt by gram, or as sure survivors where a gram is frequent."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("block", pa.int64()), ("keys", pa.binary()), ("texts", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys, texts, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, texts, places = keys[order], texts[order], places[order]
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((begins, [len(keys)])))
            nth = np.arange(len(keys)) - np.repeat(begins, sizes)
            block = (T.mix(keys) % np.uint64(blocks)).astype(np.int64)
            block[np.repeat(sizes > _OFTEN, sizes) & (nth >= 2)] = -1  # they survive; two of them speak for the gram
            order = np.argsort(block, kind="stable")
            block, keys, texts, places = block[order], keys[order], texts[order], places[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            m = len(parts)
            return pa.record_batch([pa.nulls(m, pa.int64())] * 3 + [pa.nulls(m, pa.binary()), pa.array(block[cuts[:-1]], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (keys, texts, places))], schema=schema)

        size = 0
        for rows, data, offsets in T.slices(batches):
            raw = data.tobytes()
            shas = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = np.array([_text_id(s) for s in shas], np.int64)
            m = len(ids)
            yield pa.record_batch([rows.column(0), pa.array(ids), pa.array(np.diff(offsets)), pa.array(shas, pa.binary()), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.binary())] * 3], schema=schema)
            at, _, _, keys = anchors(data, offsets, length, gram)
            text = np.searchsorted(offsets, at, "right") - 1
            new = np.zeros(m, bool)
            for i, x in enumerate(shas):
                new[i] = x not in seen
                seen.add(x)
            take = new[text]
            held.append((keys[take], ids[text[take]], (at - offsets[text])[take]))
            size += int(take.sum())
            if size > 300_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _often(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of grams that are frequent in a flush of the first pass, with how often they occur there beyond two."""
    for frame in frames:
        for keys in frame["keys"]:
            key, n = np.unique(np.frombuffer(keys, np.int64), return_counts=True)
            yield pd.DataFrame({"key": key, "n": n.astype(np.int64)})


def _survivors(clashing: list[int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one block of grams, the anchors whose gram occurs at two or more places (and all of texts that share their text_id with another); rows (text_id, places)."""
        keys, texts, places = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("keys", np.uint64), ("texts", np.int64), ("places", np.int64)))
        if pdf["block"].iloc[0] >= 0:
            order = np.lexsort((places, texts, keys))
            keys, texts, places = keys[order], texts[order], places[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]) | (places[1:] != places[:-1])))
            keys, texts, places = keys[new], texts[new], places[new]
            same = keys[1:] == keys[:-1]
            take = np.concatenate((same, [False])) | np.concatenate(([False], same)) | np.isin(texts, clashing)
            texts, places = texts[take], places[take]
        order = np.argsort(texts, kind="stable")
        texts, places = texts[order], places[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(texts)) + 1, [len(texts)])) if len(texts) else np.zeros(1, int)
        return pd.DataFrame({"text_id": texts[cuts[:-1]], "places": [places[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, reversed prefix, text_id, place): lengths and common prefixes with the entry before, then the new bytes."""
    head, tails, f, b = np.zeros((len(entries), 6), np.int64), [], b"", b""
    for i, (suffix, back, text, place) in enumerate(entries):
        x, y = common_prefix(f, suffix), common_prefix(b, back)
        head[i] = x, len(suffix), y, len(back), text, place
        tails += (suffix[x:], back[y:])
        f, b = suffix, back
    small = head[:, :4].astype(np.uint32)
    return len(entries).to_bytes(4, "little") + small.tobytes() + head[:, 4:].tobytes() + b"".join(tails)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(common prefix with the suffix before, suffix, reversed prefix, text_id, place), in order."""
    n = int.from_bytes(run[:4], "little")
    small = np.frombuffer(run, np.uint32, 4 * n, 4).reshape(n, 4).tolist()
    ids = np.frombuffer(run[4 + 16 * n : 4 + 32 * n], np.int64).reshape(n, 2).tolist()
    at, f, b = 4 + 32 * n, b"", b""
    for (x, nf, y, nb), (text, place) in zip(small, ids, strict=True):
        f = f[:x] + run[at : at + nf - x]
        at += nf - x
        b = b[:y] + run[at : at + nb - y]
        at += nb - y
        yield x, f, b, text, place


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """All entries in the order of their suffixes, each with its common prefix with the one before: a loser tree over the runs.

    A player's number is its common prefix with the last winner. Of two players, the one with the longer common prefix is smaller, without a look at its
    characters; with equal ones the comparison begins behind them, and the loser keeps what was found.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [read_run(r) for r in runs] + [iter(())] * (k - len(runs))
    now = [next(s, None) for s in sources]
    losers, known = [-1] * k, [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser."""
        if now[x] is None or now[y] is None:
            return (y, x) if now[x] is None else (x, y)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        a, b = now[x][1], now[y][1]
        p = common_prefix(a, b, known[x])
        first, second = (x, y) if p == len(a) or (p < len(b) and a[p] < b[p]) else (y, x)
        known[second] = p
        return first, second

    level = list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        won = []
        for i in range(0, len(level), 2):
            first, second = play(level[i], level[i + 1])
            losers[at + i // 2] = second
            won.append(first)
        level = won
    best = level[0]
    while now[best] is not None:
        yield known[best], now[best][1:]
        now[best] = next(sources[best], None)
        known[best] = now[best][0] if now[best] is not None else 0
        node = (k + best) // 2
        while node:
            first, second = play(best, losers[node])
            losers[node], best = second, first
            node //= 2


def _surviving(batches: Iterator[pa.RecordBatch], length: int, gram: int, hot: np.ndarray, wanted: bool):
    """For each text and slice with places of surviving anchors: the slice's bytes, the text's offset and id, and (anchor, first, last, key) of the anchors whose key is hot, or is not."""
    for rows, data, offsets in T.slices(batches):
        ids, lists = rows.column(rows.schema.get_field_index("text_id")).to_pylist(), rows.column(rows.schema.get_field_index("places")).to_pylist()
        at, first, last, keys = anchors(data, offsets, length, gram)
        text = np.searchsorted(offsets, at, "right") - 1
        raw = data.tobytes()
        cuts = np.searchsorted(text, np.arange(len(ids) + 1))
        mine = np.isin(keys, hot) == wanted
        for i, (text_id, places) in enumerate(zip(ids, lists, strict=True)):
            a, b = cuts[i], cuts[i + 1]
            take = a + np.flatnonzero(mine[a:b] & np.isin(at[a:b] - offsets[i], np.frombuffer(b"".join(places), np.int64)))
            if not len(take) or not _is(text_id, raw[offsets[i] : offsets[i + 1]]):
                continue  # another row of that doc_id
            yield raw, int(offsets[i]), text_id, at[take], first[take], last[take], keys[take]


def _runs(length: int, gram: int, blocks: int, hot: np.ndarray):
    """Texts with the places of their surviving anchors: sorted front-coded runs of the anchors' contexts but those of hot grams, dealt by gram. Equal contexts stay next to each other and
    cost a few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            by: dict[int, list] = {}
            for block, *entry in held:
                by.setdefault(block, []).append(tuple(entry))
            return pa.record_batch({"block": pa.array(list(by), pa.int64()), "run": pa.array([front_coded(sorted(x)) for x in by.values()], pa.binary())})

        for raw, offset, text_id, at, first, last, keys in _surviving(batches, length, gram, hot, False):
            block = (T.mix(keys) % np.uint64(blocks)).astype(np.int64)
            for g, p, x, y in zip(block.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
                held.append((g, raw[p : y + length], raw[x:p][::-1], text_id, p - offset))
                size += y + length - x
            if size > 24 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def repeated(group: list[tuple[bytes, bytes]], prefixes: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For anchors of one gram in the order of their suffixes, with common prefixes (the first is not read): for each, intervals (low, high) of distances
    from window start to anchor whose window another one shares: suffixes equal for length - distance bytes and reversed prefixes for distance bytes.

    Distances end at length - gram, so there are at most that many breaks, whatever n: the work grows as n log n."""
    n = len(group)
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    if n == 2:
        low, high = max(0, length - prefixes[1]), common_prefix(group[0][1], group[1][1])
        return [[(low, high)], [(low, high)]] if low <= high else out
    ahead = np.array([len(x[0]) for x in group])
    back = np.array([len(x[1]) for x in group])
    order = sorted(range(n), key=lambda i: group[i][1])
    by_back = np.array(order)
    shared_back = np.array([0] + [common_prefix(group[a][1], group[b][1]) for a, b in zip(order[:-1], order[1:], strict=True)])
    shared = np.array(prefixes)
    breaks = np.unique(np.concatenate(([0], length - shared[1:], shared_back[1:] + 1, length - ahead, back + 1)))
    breaks = breaks[(breaks >= 0) & (breaks <= back.max())]
    ends = np.concatenate((breaks[1:] - 1, [back.max()]))
    rank = np.empty(n, np.int64)
    for low, high in zip(breaks.tolist(), ends.tolist(), strict=True):
        ahead_class = np.cumsum(np.concatenate(([0], shared[1:] < length - low)))
        rank[by_back] = np.cumsum(np.concatenate(([0], shared_back[1:] < high)))
        there = np.flatnonzero((ahead >= length - low) & (back >= high))
        if len(there) < 2:
            continue
        _, which, times = np.unique(ahead_class[there] * n + rank[there], return_inverse=True, return_counts=True)
        for i in there[times[which] > 1].tolist():
            if out[i] and out[i][-1][1] == low - 1:
                out[i][-1] = (out[i][-1][0], high)
            else:
                out[i].append((low, high))
    return out


def _merged(length: int, gram: int):
    """One reducer: merge the runs of a block and report the repeated windows as (text_id, start, end) of bytes to remove."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        group: list[tuple] = []
        prefixes: list[int] = []

        def close() -> None:
            if len(group) > 1:
                for (_, _, text, place), intervals in zip(group, repeated([g[:2] for g in group], prefixes, length), strict=True):
                    found.extend((text, place - high, place - low + length) for low, high in intervals)

        seen: set[tuple[int, int]] = set()
        skipped = None
        for p, entry in merge_runs(list(pdf["run"])):
            p = p if skipped is None else min(p, skipped)
            if entry[2:] in seen:
                skipped = p
                continue
            skipped = None
            if p < gram:
                close()
                group, prefixes, seen = [], [], set()
            group.append(entry)
            prefixes.append(p)
            seen.add(entry[2:])
        close()
        return pd.DataFrame(found, columns=["text_id", "start", "end"]).astype("int64")

    return run


_CONTEXT = "text_id long, place long, low long, high long, ahead binary, back binary"


def _hot_contexts(length: int, gram: int, hot: np.ndarray):
    """Of hot grams' anchors: the contexts (suffix, reversed prefix, and the distances from window start to anchor that the anchor answers for), each once for 24 MB of what is held, and
    the spans of those that are equal in full there, joined within each text, as rows of _CONTEXT with distances 0 and null bytes (place is the start, high the end)."""
    schema = pa.schema([*((c, pa.int64()) for c in ("text_id", "place", "low", "high")), ("ahead", pa.binary()), ("back", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, set[tuple[int, int]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out, spans = [], []
            for (low, high, ahead, back), members in held.items():
                out.append((*min(members), low, high, ahead, back))
                if len(members) > 1:
                    spans += ((text, place - high, place - low + length) for text, place in members)
            now = None
            for text, start, end in sorted(spans):
                if now and now[0] == text and start <= now[2]:
                    now[2] = max(now[2], end)
                else:
                    if now:
                        out.append((now[0], now[1], 0, now[2], None, None))
                    now = [text, start, end]
            if now:
                out.append((now[0], now[1], 0, now[2], None, None))
            return pa.record_batch([pa.array([o[i] for o in out], schema.types[i]) for i in range(6)], schema=schema)

        for raw, offset, text_id, at, first, last, _ in _surviving(batches, length, gram, hot, True):
            for p, x, y in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                context = (p - y, p - x, raw[p : y + length], raw[x:p][::-1])
                if context not in held:
                    size += y + length - x
                held.setdefault(context, set()).add((text_id, p - offset))
                size += 100
            if size > 24 << 20:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _hot_repeats(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(text_id, start, end) of the repeated windows of saved rows of _CONTEXT. Every round works on a saved table and no task holds a group: of contexts with one outer key, which all repeat,
    one goes on for all, and a context leaves a range of distances when no other one has its inner key there."""
    spans = lambda t: t.select("text_id", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))
    whole, one, context = ["low", "high", "outer"], ["text_id", "place", "low", "high"], F.struct("text_id", "place")
    outer, inner = F.expr("sha2(concat(ahead, back), 256)"), F.expr(f"sha2(concat(substring(ahead, 1, cast({length} - hi as int)), substring(back, 1, cast(lo as int))), 256)")
    found = [contexts.where("ahead is null").select("text_id", F.col("place").alias("start"), F.col("high").alias("end"))]
    state = contexts.where("ahead is not null").withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(length - gram).cast("long")})
    while True:  # a round for each halving of the distances, about log2(length - gram)
        state = save(state.withColumns({"outer": outer, "inner": inner}), "contexts")
        if state.isEmpty():
            break
        classes = state.groupBy(*whole).agg(F.min(context).alias("one"), F.max(context).alias("other"), *(F.min(c).alias(c) for c in ("lo", "hi", "inner")))
        classes = save(classes, "outer")
        found.append(spans(state.select(*one, "outer").join(classes.where("one <> other").select(*whole), whole, "left_semi")))
        many = classes.where("lo < hi").groupBy("lo", "inner").agg(F.count("*").alias("n")).where("n > 1")
        goes = classes.join(many, ["lo", "inner"], "left_semi").select("one.text_id", "one.place", "low", "high")
        halves = F.expr("explode(array(struct(lo, (lo + hi) div 2 as hi), struct((lo + hi) div 2 + 1 as lo, hi)))")
        state = state.join(goes, one).select("text_id", "place", "low", "high", "ahead", "back", halves.alias("half")).select("*", "half.lo", "half.hi").drop("half")
        state = state.withColumns({"low": F.greatest("low", "lo"), "high": F.least("high", "hi")}).where("low <= high")
        state = state.withColumns({"ahead": F.expr(f"substring(ahead, 1, cast({length} - low as int))"), "back": F.expr("substring(back, 1, cast(high as int))")})
    return reduce(DataFrame.unionByName, found)


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans to remove."""
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    for batch in batches:
        docs, ids, texts, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text_id", "text", "spans"))
        out = []
        for doc, text_id, text, own in zip(docs, ids, texts, spans, strict=True):
            raw, kept, at, runs, removed = text.encode(), [], 0, 0, 0
            if not _is(text_id, raw):
                continue  # another row of that doc_id
            for start, end in sorted((s["start"], s["end"]) for s in own):
                if start > at or not runs:
                    kept.append(raw[at:start])
                    runs, at = runs + 1, start
                removed += max(0, end - at)
                at = max(at, end)
            kept.append(raw[at:])
            out.append((doc, len(raw), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pa.record_batch({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(types.items())})


def dedup_substrings(docs: DataFrame, length: int = 400, gram: int = 100, hot: int = 4096) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, a null text is empty, and matches never cross texts. Equal texts of at least `length` bytes go whole; one of them stands for all
    in the search. Rows are known by doc_id and text; other columns are not read; an empty table gives no rows. The contexts of a gram
    that is known to occur over `hot` times are not merged in one task.
    """
    docs = docs.select("doc_id", "text")
    blocks = input_blocks(docs)
    first = save(docs.mapInArrow(_first_pass(length, gram, blocks), "doc_id long, text_id long, n_bytes long, sha binary, block long, keys binary, texts binary, places binary"), "anchors")
    texts = first.where("block is null").select("doc_id", "text_id", "n_bytes", "sha")

    def known(texts: DataFrame) -> DataFrame:
        """A row for each text. The check tells texts apart that agree in text_id."""
        check = F.xxhash64("sha")
        return save(texts.groupBy("text_id").agg(F.first("first_id").alias("first_id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min(check).alias("least"), F.max(check).alias("most")), "classes")

    texts = texts.withColumn("first_id", F.col("text_id"))
    classes = known(texts)
    # of n different texts about n * n / 2**65 share a text_id: none below a few thousand millions
    clashing = [r["text_id"] for r in classes.where("least <> most").select("text_id").collect()]
    if clashing:
        digits = F.hex(F.expr("substring(sha, 9, 8)"))
        second = F.conv(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("long")  # little-endian, as _text_id reads it
        texts = texts.withColumn("text_id", F.when(F.col("text_id").isin(*clashing), second).otherwise(F.col("text_id")))
        classes = known(texts)
    survivors = _survivors(clashing)
    dealt = first.where("block >= 0").select("block", "keys", "texts", "places").groupBy("block").applyInPandas(survivors, "text_id long, places binary")
    sure = first.where("block = -1").select("block", "keys", "texts", "places").mapInPandas(lambda frames: (survivors(f.iloc[i : i + 1]) for f in frames for i in range(len(f))), "text_id long, places binary")
    places = dealt.unionByName(sure).groupBy("text_id").agg(F.collect_list("places").alias("places"))
    wanted = classes.join(places.withColumnRenamed("text_id", "first_id"), "first_id").select("doc_id", "text_id", "places")
    near = save(docs.where("text is not null").join(wanted, "doc_id"), "texts")
    often = first.where("block = -1").select("keys").mapInPandas(_often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    keys = np.array([r["key"] for r in often.collect()], np.int64).view(np.uint64)
    runs = near.mapInArrow(_runs(length, gram, blocks, keys), "block long, run binary")
    found = runs.groupBy("block").applyInPandas(_merged(length, gram), "text_id long, start long, end long")
    if len(keys):
        found = found.unionByName(_hot_repeats(save(near.mapInArrow(_hot_contexts(length, gram, keys), _CONTEXT), "hot"), length, gram))
    found = save(found.groupBy("text_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")

    marked = texts.join(classes.select("text_id", "copies"), "text_id").join(found.select("text_id", F.lit(True).alias("hit")), "text_id", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    rest = marked.where(whole | F.col("hit").isNull()).select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, nothing).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
    alone = marked.where(~whole & F.col("hit")).select("doc_id", "text_id")
    cut = near.select("doc_id", "text_id", "text").join(alone, ["doc_id", "text_id"]).join(found, "text_id").mapInArrow(_cut, _CUT)
    return rest.unionByName(cut)
